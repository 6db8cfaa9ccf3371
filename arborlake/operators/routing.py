"""Routing of samples to children and prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.heap import child


def goes_right(value: Column, threshold: Column) -> Column:
    """The split predicate, compared as floats; a missing value goes left."""
    return F.coalesce(value.cast("float") > threshold.cast("float"), F.lit(False))


def route(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Samples whose node has a split move to one of its children; narrow but for the broadcast.

    ``splits`` has one row a node of a level, so its size is bounded by the tree.
    """
    s = splits.select(F.col("node_id").alias("at"), F.col("feature_id").alias("f"), F.col("threshold").alias("t"))
    joined = samples.join(F.broadcast(s), F.col("node_id") == F.col("at"), "left")
    moved = child(F.col("node_id"), goes_right(F.get("features", F.col("f")), F.col("t")))
    return joined.withColumn("node_id", F.when(F.col("at").isNotNull(), moved).otherwise(F.col("node_id"))).drop("at", "f", "t")


def predict(samples: DataFrame, leaves: DataFrame) -> DataFrame:
    """Samples with the label of their leaf; leaves is one row a leaf."""
    return samples.join(F.broadcast(leaves.select("node_id", F.col("label").alias("prediction"))), "node_id", "left")
