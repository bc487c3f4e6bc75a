"""Evaluate an expression once and use it many times inside one column expression.

A lambda body that names a computed column may see that column's whole expression put in its
place by the optimizer, and then evaluates it per array element. A lambda variable cannot be
replaced, so binding keeps the cost linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
