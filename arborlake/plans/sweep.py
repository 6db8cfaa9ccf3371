"""Benchmark sweeps: generated data, a tree for each case, one row of results."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from arborlake.operators.datasets import bench_dataset, classes_of_depth
from arborlake.operators.evaluate import accuracy
from arborlake.operators.sizing import estimate_bytes, sweep
from arborlake.plans.tree import fit

RESULT = (
    "suite string, name string, num_samples bigint, num_features int, max_depth int, folding_depth int, num_thresholds int, pool_size int, "
    "feature_type string, num_classes int, estimated_mb double, cap_mb double, status string, tree_time_sec double, final_depth int, final_success_pct double"
)


def run_case(spark: SparkSession, case: dict, type_name: str, cap_mb: float) -> tuple:
    """One row of ``RESULT``; a case whose estimate exceeds the cap is refused and not run."""
    depth, classes = case["max_depth"], classes_of_depth(case["max_depth"])
    mb = estimate_bytes(case["num_samples"], depth, case["folding_depth"], classes, type_name) / 1048576
    head = (*(case[k] for k in ("suite", "name", "num_samples", "num_features", "max_depth", "folding_depth", "num_thresholds", "pool_size")), type_name, classes, mb, float(cap_mb))
    if mb > cap_mb:
        return (*head, "refused", None, None, None)
    samples, meta = bench_dataset(spark, case["num_samples"], case["num_features"], depth, type_name)
    began = time.time()
    tree = fit(samples, depth, case["num_thresholds"], meta=meta)
    took = time.time() - began
    return (*head, "ok", took, depth, accuracy(tree.predict(samples)).first().accuracy)


def run_sweep(spark: SparkSession, samples: list[int], features: list[int], depths: list[int], num_thresholds: int = 8, type_name: str = "F_CHAR", cap_mb: float = 500.0) -> DataFrame:
    """Results of all cases of a sweep."""
    return spark.createDataFrame([run_case(spark, c, type_name, cap_mb) for c in sweep(samples, features, depths, num_thresholds)], RESULT)
