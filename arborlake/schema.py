"""Schemas of the tables and the checks made on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes a label may have.
MAX_CLASSES = 1 << 14
#: Feature types with their Spark type, bytes, threshold proxy and largest depth feature.
FEATURE_TYPES = {
    "F_CHAR": ("tinyint", 1, 127.0, 127.0),
    "F_SHORT": ("smallint", 2, 32767.0, 32767.0),
    "F_INT": ("int", 4, 2147483500.0, 2147483500.0),
    "F_FLOAT": ("float", 4, 1024.0, 3.3e37),
}
SAMPLES = "sample_id bigint, label int, features array<float>"
THRESH_META = "feature_id int, max_proxy float, fmin float, fmax float"
CANDIDATES = "feature_id int, threshold_id int, threshold float"
CLASS_WEIGHTS = "label int, w bigint"
SPLITS = "node_id bigint, feature_id int, threshold_id int, threshold float, gain double, left_entropy double, right_entropy double, n_left bigint, n_right bigint"


def feature_type(name: str) -> tuple[str, int, float, float]:
    """Properties of a feature type; an unknown one is an error."""
    if name not in FEATURE_TYPES:
        raise ValueError(f"feature type {name!r}: expected one of {', '.join(FEATURE_TYPES)}")
    return FEATURE_TYPES[name]


def validated(samples: DataFrame) -> DataFrame:
    """``samples`` whose evaluation fails on a label outside 0..MAX_CLASSES-1 or null."""
    bad = F.col("label").isNull() | (F.col("label") < 0) | (F.col("label") >= MAX_CLASSES)
    label = F.when(bad, F.raise_error(F.concat(F.lit("label out of range: "), F.coalesce(F.col("label").cast("string"), F.lit("null"))))).otherwise(F.col("label"))
    return samples.withColumn("label", label.cast("int"))
