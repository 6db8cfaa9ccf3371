"""Growing a complete tree level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators import evaluate, weights
from arborlake.operators.histograms import BROADCAST_ROWS, child_histogram, left_histogram, parent_histogram
from arborlake.operators.routing import predict, route
from arborlake.operators.split import best_split, score_splits
from arborlake.operators.thresholds import candidates, threshold_metadata
from arborlake.schema import SPLITS, validated


@dataclass
class Tree:
    """A trained tree as DataFrames: nodes (splits), hists and leaves."""

    max_depth: int
    nodes: DataFrame
    hists: DataFrame
    leaves: DataFrame

    def assign(self, samples: DataFrame) -> DataFrame:
        """Samples with the leaf they reach."""
        out = samples.withColumn("node_id", F.lit(0).cast("bigint"))
        for depth in range(self.max_depth + 1):
            first = (1 << depth) - 1
            out = route(out, self.nodes.where(F.col("node_id").between(first, 2 * first)))
        return out

    def predict(self, samples: DataFrame) -> DataFrame:
        """Samples with node_id and prediction; a projection, so it also runs on a stream."""
        return predict(self.assign(samples), self.leaves)


def fit_level(samples: DataFrame, cands: DataFrame, class_weights: DataFrame, parents: DataFrame | None = None, measure: str = "shannon", num_features: int | None = None) -> DataFrame:
    """Best split of each node that has samples, with its threshold; the splits of a level are broadcast, not the candidates."""
    both = left_histogram(parent_histogram(samples), child_histogram(samples, cands, num_features))
    best = best_split(score_splits(both, class_weights, measure, parents))
    return cands.join(F.broadcast(best), ["feature_id", "threshold_id"]).select("node_id", "feature_id", "threshold_id", "threshold", "gain", "left_entropy", "right_entropy", "n_left", "n_right")


def local(rows: DataFrame) -> DataFrame:
    """``rows`` held by the driver if there are at most ``BROADCAST_ROWS`` of them, else persisted."""
    few = rows.limit(BROADCAST_ROWS + 1).collect()
    return rows.sparkSession.createDataFrame(few, rows.schema) if len(few) <= BROADCAST_ROWS else rows.persist()


def fit(samples: DataFrame, max_depth: int, num_thresholds: int, *, meta: DataFrame | None = None, weight_type: str = "ones", class_weights: DataFrame | None = None, measure: str = "shannon", max_proxy: float = 1024.0, num_features: int | None = None) -> Tree:
    """Train a complete tree of ``2^(max_depth+1) - 1`` splits.

    Per level one query returns at most ``2^depth`` rows to the driver; samples
    are never collected or rewritten, their node is an expression over the
    splits found so far.  An empty node gets feature 0 and threshold 0.
    Candidates and the histograms of all nodes become local tables below
    ``BROADCAST_ROWS`` rows and stay with the executors above.
    """
    spark = samples.sparkSession
    samples = validated(samples)
    meta = threshold_metadata(samples, max_proxy) if meta is None else meta
    cands = local(candidates(meta, num_thresholds))
    if class_weights is None:
        class_weights = {"ones": weights.ones, "apriori": weights.apriori}[weight_type](samples)
    class_weights = spark.createDataFrame(class_weights.collect(), class_weights.schema)  # a row a class
    current, splits, entropy = samples.withColumn("node_id", F.lit(0).cast("bigint")), {}, {0: 0.0}
    default = next((r.threshold for r in cands.where("feature_id = 0 and threshold_id = 0").collect()), 0.0)
    for depth in range(max_depth + 1):
        level = range((1 << depth) - 1, (2 << depth) - 1)
        parents = spark.createDataFrame([(n, float(entropy.get(n, 0.0))) for n in level], "node_id bigint, entropy double")
        found = {r.node_id: r for r in fit_level(current, cands, class_weights, parents, measure, num_features).collect()}
        for n in level:
            r = found.get(n)
            splits[n] = tuple(r) if r else (n, 0, 0, default, 0.0, 0.0, 0.0, 0, 0)
            entropy[2 * n + 1], entropy[2 * n + 2] = splits[n][5], splits[n][6]
        current = route(current, spark.createDataFrame([splits[n] for n in level], SPLITS))
    nodes = spark.createDataFrame([splits[n] for n in sorted(splits)], SPLITS)
    hists = local(evaluate.tree_histograms(current, max_depth + 1))
    every = spark.range((4 << max_depth) - 1).select(F.col("id").alias("node_id"))
    leaves = every.where(F.col("node_id") >= (2 << max_depth) - 1).join(evaluate.majority(hists), "node_id", "left")
    leaves = leaves.select("node_id", F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("max_val", F.lit(0)).alias("max_val"))
    return Tree(max_depth, nodes, hists, leaves)
