"""Threshold metadata and candidate thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.impurity import EPS


def unpivot(samples: DataFrame, *keep: str, num_features: int | None = None) -> DataFrame:
    """One row per sample and feature: the kept columns, feature_id, value (float).

    With ``num_features`` only the first ones are unpivoted.
    """
    features = F.col("features") if num_features is None else F.slice("features", 1, num_features)
    return samples.select(*keep, F.posexplode(features).alias("feature_id", "value")).withColumn("value", F.col("value").cast("float"))


def threshold_metadata(samples: DataFrame, max_proxy: float = 1024.0, sentinel: float | None = None) -> DataFrame:
    """Per feature its proxy, least and largest value.

    Values equal to ``sentinel`` in size do not count; a feature without any
    valid value gets the whole range of the sentinel.
    """
    rows = unpivot(samples)
    if sentinel is None:
        low, high = F.min("value"), F.max("value")
    else:
        valid = F.when(F.abs("value") != F.lit(sentinel).cast("float"), F.col("value"))
        low, high = F.coalesce(F.min(valid), F.lit(-sentinel).cast("float")), F.coalesce(F.max(valid), F.lit(sentinel).cast("float"))
    return rows.groupBy("feature_id").agg(low.alias("fmin"), high.alias("fmax")).select("feature_id", F.lit(max_proxy).cast("float").alias("max_proxy"), "fmin", "fmax")


def threshold_value(i: int, count: int) -> Column:
    """Candidate ``i`` of ``count`` for a row of threshold metadata, in float arithmetic."""
    eps = F.lit(EPS).cast("float")
    if i == 0:
        return (F.floor(F.col("max_proxy") / 2 - 1).cast("float") - eps).cast("float")
    if i == 1:
        return (F.lit(0.0).cast("float") - eps).cast("float")
    low = (F.col("fmin") - eps).cast("float")
    if i == 2:
        return low
    step = ((F.col("fmax") - F.col("fmin")).cast("float") / F.lit(count - 3).cast("float")).cast("float")
    return (low + (F.lit(i - 2).cast("float") * step).cast("float")).cast("float")


def candidates(meta: DataFrame, count: int) -> DataFrame:
    """(feature_id, threshold_id, threshold); ids are not in the order of values."""
    if count < 1:
        raise ValueError("at least one threshold is needed")
    rows = F.array(*[F.struct(F.lit(i).alias("threshold_id"), threshold_value(i, count).alias("threshold")) for i in range(count)])
    return meta.select("feature_id", F.explode(rows).alias("c")).select("feature_id", "c.threshold_id", "c.threshold")
