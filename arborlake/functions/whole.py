"""Whole-number helpers as column expressions, for values of 0 and more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_div(a: Column, b: Column) -> Column:
    """How many groups of ``b`` hold ``a`` things."""
    return F.call_function("div", a, b) + (a % b != 0).cast("bigint")


def snap_down(a: Column, b: Column) -> Column:
    """The largest multiple of ``b`` that is not above ``a``."""
    return a - a % b
