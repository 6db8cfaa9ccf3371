"""The log of a training run: lines with levels, shown and appended to a file.

It is written by the driver, a few lines a tree; ``sources.tables.parse_log`` reads it.
"""

from __future__ import annotations

import sys
from datetime import datetime

from pyspark.sql import functions as F

from arborlake.operators.evaluate import progress
from arborlake.plans.tree import Tree

# Levels, the most important first; the last five are set in by a tab each.
LEVELS = ("ERROR", "WARNING", "INFO", "LOG0", "LOG1", "LOG2", "LOG3", "LOG4")


class RunLog:
    """Lines up to ``level`` go to standard error and to the end of the file at ``path``, if one is given."""

    def __init__(self, path: str | None = None, level: str = "LOG4"):
        self.path, self.most = path, LEVELS.index(level)

    def write(self, level: str, message: str) -> None:
        rank = LEVELS.index(level)
        if rank > self.most:
            return
        line = f"- {datetime.now():%H:%M:%S.%f} {level}: {chr(9) * max(0, rank - LEVELS.index('LOG0'))}{message}\n"
        sys.stderr.write(line)
        if self.path:
            with open(self.path, "a", encoding="utf-8") as out:
                out.write(line)

    def tree(self, tree: Tree, number: int, seconds: float) -> None:
        """The share of samples that are right below each depth, and the time that training took."""
        for row in progress(tree.hists).orderBy(F.col("depth")).collect():  # a row a level
            self.write("LOG0", f"Depth {row.depth}: {row.success_pct:.4f}%")
        self.write("LOG0", f"Processed Tree {number} in {seconds:.4f}s")
