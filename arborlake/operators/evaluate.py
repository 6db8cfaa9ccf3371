"""Histograms of finished trees, leaf labels and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.heap import ancestors
from arborlake.functions.heap import depth as node_depth


def tree_histograms(samples: DataFrame, levels: int) -> DataFrame:
    """(node_id, label, n) of every node from the leaves of samples, ``levels`` below the root.

    Leaves are counted first, so only leaf counts are rolled up along the path.
    """
    leaves = samples.groupBy("node_id", "label").agg(F.count("*").alias("n"))
    return leaves.select(F.explode(ancestors(F.col("node_id"), levels)).alias("node_id"), "label", "n").groupBy("node_id", "label").agg(F.sum("n").alias("n"))


def majority(hist: DataFrame) -> DataFrame:
    """(node_id, label, max_val): a node's largest class; ties go to the lowest label."""
    best = hist.groupBy("node_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
    return best.select("node_id", F.col("b.label").alias("label"), (-F.col("b.n")).alias("max_val"))


def byte_histogram(hist: DataFrame) -> DataFrame:
    """(node_id, label, n, n_byte): counts scaled to 0..255 by the node's largest; 0 for an empty node."""
    top = hist.groupBy("node_id").agg(F.max("n").alias("top"))
    scaled = F.when(F.col("top") > 0, F.floor(F.col("n") * 255 / F.when(F.col("top") > 0, F.col("top")))).otherwise(F.lit(0))
    return hist.join(top, "node_id").select("node_id", "label", "n", scaled.cast("smallint").alias("n_byte"))


def progress(hist: DataFrame) -> DataFrame:
    """(depth, n, correct, success_pct): how many samples a tree cut off below each depth would get right, from its histograms alone."""
    nodes = hist.where("node_id > 0").groupBy("node_id").agg(F.sum("n").alias("n"), F.max("n").alias("correct"))
    levels = nodes.groupBy((node_depth(F.col("node_id")) - 1).alias("depth")).agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    return levels.select("depth", "n", "correct", F.round(F.try_divide(F.col("correct") * F.lit(100.0), F.col("n")), 9).alias("success_pct"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: n, correct, accuracy in percent (null without rows)."""
    right = F.sum((F.col("label") == F.col("prediction")).cast("bigint"))
    return predictions.agg(F.count("*").alias("n"), F.coalesce(right, F.lit(0)).alias("correct")).select("n", "correct", F.round(F.try_divide(F.col("correct") * F.lit(100.0), F.col("n")), 9).alias("accuracy"))


def per_class_accuracy(predictions: DataFrame, num_classes: int) -> DataFrame:
    """(label, n, share, accuracy) in percent for every class; accuracy is null for an absent one."""
    counts = predictions.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("bigint")).alias("correct"))
    total = F.broadcast(predictions.agg(F.count("*").alias("total")))
    classes = predictions.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("label"))
    rows = classes.join(counts, "label", "left").join(total)
    n = F.coalesce("n", F.lit(0))
    return rows.select("label", n.alias("n"), F.round(F.try_divide(n * F.lit(100.0), F.col("total")), 9).alias("share"), F.round(F.try_divide(F.col("correct") * F.lit(100.0), F.col("n")), 9).alias("accuracy"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Long form: (label, prediction, n)."""
    return predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, num_classes: int) -> DataFrame:
    """Wide form: a row a true class, a column a predicted one."""
    return predictions.groupBy("label").pivot("prediction", list(range(num_classes))).count().na.fill(0)
