"""Class histograms of nodes and of candidate splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.thresholds import unpivot

#: Candidate tables of more rows are joined by shuffle instead of being sent to all executors.
BROADCAST_ROWS = 500_000


def parent_histogram(samples: DataFrame) -> DataFrame:
    """(node_id, label, n)."""
    return samples.groupBy("node_id", "label").agg(F.count("*").alias("n"))


def child_histogram(samples: DataFrame, candidates: DataFrame, num_features: int | None = None) -> DataFrame:
    """(node_id, feature_id, threshold_id, label, n_right): samples with value > threshold.

    A value is located once among its feature's thresholds, sorted, by adding
    up comparisons, so rows are samples x features and never x thresholds.  Bins
    are counted with map-side partial aggregation, and a suffix sum over the
    few bins of a (node, feature, label) gives the counts of all thresholds.
    Every label of a node appears, with 0 where nothing lies right.
    """
    spark, fields = samples.sparkSession, "feature_id int, threshold_id int, rank int"
    ordered = candidates.groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("threshold", "threshold_id"))).alias("all"))
    few = ordered.limit(BROADCAST_ROWS // 16 + 1).collect()
    if sum(len(r["all"]) for r in few) <= BROADCAST_ROWS // 2 and len(few) <= BROADCAST_ROWS // 16:
        width = max((len(r["all"]) for r in few), default=0)
        names = "".join(f", t{i} float" for i in range(width))
        rows = [(r.feature_id, *[r["all"][i].threshold if i < len(r["all"]) else None for i in range(width)]) for r in few]
        by_feature = F.broadcast(spark.createDataFrame(rows, "feature_id int" + names))
        ranks = F.broadcast(spark.createDataFrame([(r.feature_id, c.threshold_id, k) for r in few for k, c in enumerate(r["all"], 1)], fields))
    else:
        width = ordered.agg(F.max(F.size("all"))).first()[0] or 0
        by_feature = ordered.select("feature_id", *[F.get("all", i).getField("threshold").alias(f"t{i}") for i in range(width)])
        ranks = ordered.select("feature_id", F.posexplode("all").alias("k", "c")).select("feature_id", "c.threshold_id", (F.col("k") + 1).alias("rank"))
    located = unpivot(samples, "node_id", "label", num_features=num_features).join(by_feature, "feature_id")
    above = sum((F.coalesce((F.col("value") > F.col(f"t{i}")).cast("int"), F.lit(0)) for i in range(width)), F.lit(0))
    bins = located.select("node_id", "feature_id", "label", above.alias("bin")).groupBy("node_id", "feature_id", "label", "bin").agg(F.count("*").alias("n"))
    # bin b holds the samples above exactly the b smallest thresholds
    per_label = bins.groupBy("node_id", "feature_id", "label").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
    right = F.aggregate(F.filter("bins", lambda b: b.bin >= F.col("rank")), F.lit(0).cast("bigint"), lambda a, b: a + b.n)
    return per_label.join(ranks, "feature_id").select("node_id", "feature_id", "threshold_id", "label", right.alias("n_right"))


def left_histogram(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(node_id, feature_id, threshold_id, label, n_left, n_right): left = parent - right."""
    return child.join(parent, ["node_id", "label"]).select("node_id", "feature_id", "threshold_id", "label", (F.col("n") - F.col("n_right")).alias("n_left"), "n_right")


def node_of_position(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range join: each position with the node whose [idx_begin, idx_end] holds it.

    Ranges are cut where multiples of their mean width lie and joined by that
    multiple, so no position is compared with all ranges; the pieces are at
    most three times the ranges.
    """
    filled = ranges.where("idx_begin <= idx_end")
    n, width = filled.agg(F.count("*"), F.ceil(F.avg(F.col("idx_end") - F.col("idx_begin") + 1))).first()
    step = F.lit(int(width or 1)).cast("bigint")
    part = lambda c: F.call_function("div", F.col(c), step)
    pieces = filled.withColumn("part", F.explode(F.sequence(part("idx_begin"), part("idx_end"))))
    pieces = F.broadcast(pieces) if 3 * n <= BROADCAST_ROWS else pieces
    on = (F.col("pos") >= F.col("idx_begin")) & (F.col("pos") <= F.col("idx_end"))
    return positions.withColumn("part", part("pos")).join(pieces, "part").where(on).select("pos", "node_id")
