"""Memory estimates and benchmark sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.schema import feature_type

# Sizes, in bytes, that the published estimate is made of.
BLOCK = 1024 * 1024
PARTIAL_HISTOGRAMS = 2 * 32768 * 64 * 4
NODE, SAMPLE, COUNT, HEADROOM = 48, 2, 4, 32 * 1024 * 1024


def estimate_bytes(num_samples: int, max_depth: int, folding_depth: int, num_classes: int, type_name: str, streams: int = 1) -> int:
    """Device memory that a training run of these sizes takes."""
    width = feature_type(type_name)[1]
    fixed = PARTIAL_HISTOGRAMS + HEADROOM + 2 * ((2 << max_depth) - 1) * NODE
    by_class = num_classes * COUNT * (1 + 2 * (1 << folding_depth))
    return fixed + by_class + num_samples * SAMPLE + streams * (num_samples * width + BLOCK * (COUNT + width))


def estimates(cases: DataFrame, type_name: str, cap_mb: float | None = None) -> DataFrame:
    """(num_samples, max_depth, folding_depth, num_classes, ...) -> the same with bytes, mb and fits."""
    width = feature_type(type_name)[1]
    power = lambda c: F.pow(F.lit(2.0), F.col(c)).cast("bigint")
    size = F.lit(PARTIAL_HISTOGRAMS + HEADROOM) + 2 * (power("max_depth") * 2 - 1) * NODE + F.col("num_classes") * COUNT * (1 + 2 * power("folding_depth")) + F.col("num_samples") * (SAMPLE + width) + BLOCK * (COUNT + width)
    mb = F.col("bytes") / F.lit(1024.0 * 1024.0)
    fits = F.lit(True) if cap_mb is None else mb <= cap_mb
    return cases.withColumn("bytes", size.cast("bigint")).withColumn("mb", F.round(mb, 6)).withColumn("fits", fits)


def require_fit(rows: DataFrame) -> DataFrame:
    """``rows`` of ``estimates``; ends the program with status 2 if one does not fit."""
    if not rows.where(~F.col("fits")).isEmpty():
        raise SystemExit(2)
    return rows


def sweep(samples: list[int], features: list[int], depths: list[int], num_thresholds: int) -> list[dict]:
    """Benchmark cases: each list varies while the others stay at their middle (depth: largest) value."""
    samples, features, depths = sorted(samples), sorted(features), sorted(depths)
    if not (samples and features and depths):
        raise ValueError("each list needs a value")
    s, f, d = samples[len(samples) // 2], features[len(features) // 2], depths[-1]
    rows = [("samples", x, f, d) for x in samples] + [("features", s, x, d) for x in features] + [("depths", s, f, x) for x in depths]
    return [{"suite": suite, "name": f"{suite}-s{a}-f{b}-d{c}", "num_samples": a, "num_features": b, "max_depth": c, "folding_depth": c, "num_thresholds": num_thresholds, "pool_size": min(b, 32)} for suite, a, b, c in rows]


def int_list(raw: str) -> list[int]:
    """Whole numbers separated by commas; none is an error."""
    found = [int(x) for x in raw.split(",") if x.strip()]
    if not found:
        raise ValueError("expected at least one number")
    return found
