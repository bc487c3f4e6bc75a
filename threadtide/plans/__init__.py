"""Whole jobs: build the feature table, write the report, run the tests, train the models."""
