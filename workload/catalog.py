"""Imports every module that registers queries."""

from workload import collect, features, jobs, modelling, tables  # noqa: F401
