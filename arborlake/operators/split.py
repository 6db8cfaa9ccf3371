"""Scores of candidate splits and the best one per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.impurity import compared, gini, p_log_p, shannon, split_gain


def node_impurity(hist: DataFrame, weights: DataFrame, measure: str = "shannon") -> DataFrame:
    """(node_id, total, impurity) of a parent histogram; classes of weight 0 do not count."""
    p = F.col("n") / F.col("w")
    sums = hist.join(weights, "label").where("w > 0").select("node_id", p.alias("p")).groupBy("node_id").agg(F.sum("p").alias("total"), F.sum(p_log_p(F.col("p"))).alias("plogp"), F.sum(F.col("p") * F.col("p")).alias("squares"))
    return sums.select("node_id", "total", (shannon(F.col("total"), F.col("plogp")) if measure == "shannon" else gini(F.col("total"), F.col("squares"))).alias("impurity"))


def score_splits(left_right: DataFrame, weights: DataFrame, measure: str = "shannon", parents: DataFrame | None = None) -> DataFrame:
    """(node_id, feature_id, threshold_id, gain, left_entropy, right_entropy, n_left, n_right).

    One aggregation over classes yields both sides' sums.  ``parents`` has
    (node_id, entropy); without it, as at the root, a node's entropy is 0.
    """
    rows = left_right.join(weights, "label").where("w > 0").select("node_id", "feature_id", "threshold_id", "n_left", "n_right", (F.col("n_left") / F.col("w")).alias("l"), (F.col("n_right") / F.col("w")).alias("r"))
    sums = [F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")]
    for side in "lr":
        sums += [F.sum(side).alias(f"{side}_total"), F.sum(p_log_p(F.col(side))).alias(f"{side}_plogp"), F.sum(F.col(side) * F.col(side)).alias(f"{side}_squares")]
    rows = rows.groupBy("node_id", "feature_id", "threshold_id").agg(*sums)
    of = {s: (shannon(F.col(f"{s}_total"), F.col(f"{s}_plogp")) if measure == "shannon" else gini(F.col(f"{s}_total"), F.col(f"{s}_squares"))) for s in "lr"}
    rows = rows.withColumn("left_entropy", of["l"]).withColumn("right_entropy", of["r"])
    parent = F.lit(0.0)
    if parents is not None:
        rows, parent = rows.join(F.broadcast(parents), "node_id", "left"), F.coalesce("entropy", F.lit(0.0))
    gain = split_gain(parent, F.col("l_total"), F.col("left_entropy"), F.col("r_total"), F.col("right_entropy"))
    return rows.select("node_id", "feature_id", "threshold_id", gain.alias("gain"), "left_entropy", "right_entropy", "n_left", "n_right")


def best_split(scores: DataFrame) -> DataFrame:
    """The split of largest gain per node; ties go to the smaller feature, then threshold id.

    A minimum over ordered structs, so candidates are reduced before the shuffle.
    """
    order = F.struct((-compared(F.col("gain"))).alias("g"), "feature_id", "threshold_id", "gain", "left_entropy", "right_entropy", "n_left", "n_right")
    best = scores.groupBy("node_id").agg(F.min(order).alias("b"))
    return best.select("node_id", *[F.col(f"b.{c}") for c in ("feature_id", "threshold_id", "gain", "left_entropy", "right_entropy", "n_left", "n_right")])
