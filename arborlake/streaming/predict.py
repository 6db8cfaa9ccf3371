"""Prediction on a stream: trees are projections, so they apply to unbounded input as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arborlake.plans.tree import Tree


def predict_stream(stream: DataFrame, tree: Tree) -> DataFrame:
    """A streaming DataFrame of samples with node_id and prediction."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return tree.predict(stream)
