"""Impurity measures as column expressions.

They are sums over classes, so an aggregate of p = n / w, p squared and
p * log2(p + eps) per group is enough; ``shannon`` and ``gini`` then combine
the sums.  Classes of weight 0 are left out by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5
#: Decimals to which gains are compared and shown; engines add in different orders.
DECIMALS = 9


def p_log_p(p: Column) -> Column:
    """The term of one class."""
    return p * F.log2(p + F.lit(EPS))


def shannon(total: Column, plogp: Column) -> Column:
    """Weighted Shannon entropy from sum(p) and sum(p log2(p + eps)); 0 for an empty set."""
    safe = F.when(total > 0, total)
    return F.when(total > 0, F.log2(safe) - plogp / safe).otherwise(F.lit(0.0))


def gini(total: Column, squares: Column) -> Column:
    """Weighted Gini impurity from sum(p) and sum(p^2); 0 for an empty set."""
    safe = F.when(total > 0, total)
    return F.when(total > 0, F.lit(1.0) - squares / (safe * safe)).otherwise(F.lit(0.0))


def split_gain(parent: Column, left_total: Column, left: Column, right_total: Column, right: Column) -> Column:
    """Parent impurity minus the children's weighted mean."""
    return parent - (left_total * left + right_total * right) / (left_total + right_total + F.lit(EPS))


def compared(x: Column) -> Column:
    return F.round(x, DECIMALS)
