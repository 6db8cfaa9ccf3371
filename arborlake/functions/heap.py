"""Arithmetic on nodes of a complete binary tree in heap order (root 0, children 2n+1 and 2n+2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def child(node: Column, right: Column) -> Column:
    return (node * 2 + 1 + right.cast("int")).cast("bigint")


def depth(node: Column) -> Column:
    return (F.length(F.bin(node + 1)) - 1).cast("int")


def ancestors(node: Column, levels: int) -> Column:
    """The node and all above it, for a node ``levels`` below the root."""
    return F.array(*[(F.shiftright(node + 1, k) - 1).cast("bigint") for k in range(levels + 1)])
