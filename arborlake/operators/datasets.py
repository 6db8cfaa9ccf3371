"""Dataset inspection, expansion and synthetic data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.schema import SAMPLES, THRESH_META, feature_type


def inspect(samples: DataFrame) -> DataFrame:
    """One row: num_samples, num_features, num_classes."""
    return samples.agg(F.count("*").alias("num_samples"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("num_features"), (F.coalesce(F.max("label"), F.lit(-1)) + 1).alias("num_classes"))


def label_histogram(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count("*").alias("n"))


def label_stats(labels: DataFrame) -> DataFrame:
    """One row: num_samples, num_classes = max(label) + 1."""
    return labels.agg(F.count("label").alias("num_samples"), (F.max("label") + 1).alias("num_classes"))


def tile(samples: DataFrame, out_samples: int) -> DataFrame:
    """Repeat samples 0..n-1 by modulo up to ``out_samples`` rows.

    Each sample makes its own copies, so nothing is joined: sample i goes to
    i, i + n, i + 2n, ...
    """
    n = samples.count()
    if not n:
        raise ValueError("no samples to tile")
    ids = F.filter(F.transform(F.sequence(F.lit(0), F.lit((out_samples - 1) // n if out_samples else 0)), lambda k: F.col("sample_id") + k * F.lit(n)), lambda x: x < out_samples)
    return samples.withColumn("sample_id", F.explode(ids))


def repeat_features(samples: DataFrame, out_features: int) -> DataFrame:
    """Feature i of the result is feature i modulo the number of features."""
    f = F.col("features")
    return samples.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(out_features - 1)), lambda i: F.get(f, i % F.size(f))))


def repeat_metadata(meta: DataFrame, out_features: int, key: str = "feature_id") -> DataFrame:
    """Rows of a table per feature, repeated by modulo."""
    n = meta.count()
    if not n:
        raise ValueError("no features to repeat")
    ids = F.filter(F.transform(F.sequence(F.lit(0), F.lit((out_features - 1) // n)), lambda k: F.col(key) + k * F.lit(n)), lambda x: x < out_features)
    return meta.withColumn(key, F.explode(F.transform(ids, lambda x: x.cast("int"))))


def cast_features(samples: DataFrame, type_name: str) -> DataFrame:
    """Features in another type; a value that does not fit is an error."""
    kind = feature_type(type_name)[0]
    return samples.withColumn("features", F.transform("features", lambda x: x.cast(kind)))


def relabel(samples: DataFrame, mode: str, in_classes: int, out_classes: int, seed: int = 0) -> DataFrame:
    """Labels ``real`` (each class split), ``uniform`` or ``unbalanced`` (0 against the rest).

    Draws are seeded hashes of sample_id.  If the top class does not occur,
    sample 0 gets it.
    """
    draw = F.xxhash64("sample_id", F.lit(seed))
    divisor = math.ceil(out_classes / in_classes)
    made: dict[str, Column] = {
        "unbalanced": (F.col("label") > 0).cast("int"),
        "uniform": F.pmod(draw, F.lit(out_classes)).cast("int"),
        "real": F.least(F.col("label") * divisor + F.pmod(draw, F.lit(divisor)).cast("int"), F.lit(out_classes - 1)),
    }
    if mode not in made:
        raise ValueError(f"unknown class distribution {mode!r}")
    out = samples.withColumn("label", made[mode].cast("int"))
    top = F.broadcast(out.agg(F.coalesce(F.max((F.col("label") == out_classes - 1).cast("int")), F.lit(0)).alias("has_top")))
    fixed = F.when((F.col("has_top") == 0) & (F.col("sample_id") == 0), F.lit(out_classes - 1)).otherwise(F.col("label"))
    return out.join(top).withColumn("label", fixed).drop("has_top")


def classes_of_depth(depth: int) -> int:
    return min(1 << max(depth, 1), 256)


def bench_dataset(spark: SparkSession, num_samples: int, num_features: int, depth: int, type_name: str) -> tuple[DataFrame, DataFrame]:
    """Samples that a tree of ``depth`` separates, and their threshold metadata."""
    kind, _, proxy, _ = feature_type(type_name)
    classes = classes_of_depth(depth)
    leaf = (F.col("id") % classes).cast("int")
    value = lambda f: (F.shiftright(leaf, depth - 1 - f) % 2) * 2 - 1 if f < depth else (leaf * (f + 3) + f) % 5 - 2
    samples = spark.range(num_samples).select(F.col("id").alias("sample_id"), leaf.alias("label"), F.array(*[value(f).cast(kind) for f in range(num_features)]).alias("features"))
    low = F.when(F.col("id") < depth, F.lit(-1.0)).otherwise(F.lit(-2.0))
    high = F.when(F.col("id") < depth, F.lit(1.0)).otherwise(F.lit(2.0))
    meta = spark.range(num_features).select(F.col("id").cast("int").alias("feature_id"), F.lit(proxy).cast("float").alias("max_proxy"), low.cast("float").alias("fmin"), high.cast("float").alias("fmax"))
    return samples, meta


def smoke(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, int]:
    """The two small known cases, ``root`` and ``depth1``: samples, metadata, depth."""
    if name == "root":
        labels = [0] * 8 + [1] * 8
        columns = [[-1.0] * 8 + [1.0] * 8, [0.0, 1.0, 0.0, 1.0, -1.0, 0.5, -0.5, 0.25] * 2, [i % 4 - 1.5 for i in range(16)], [0.25, -0.25, 0.5, -0.5] * 4]
    elif name == "depth1":
        labels = [k for k in range(4) for _ in range(4)]
        columns = [[-1.0] * 8 + [1.0] * 8, ([-1.0] * 4 + [1.0] * 4) * 2, [0.0, 0.25, 0.5, 0.75] * 4, [-0.75, -0.25, 0.25, 0.75] * 4]
    else:
        raise ValueError(f"unknown case {name!r}")
    samples = spark.createDataFrame([(i, labels[i], [c[i] for c in columns]) for i in range(16)], SAMPLES)
    return samples, spark.createDataFrame([(f, 10.0, -1.0, 1.0) for f in range(4)], THRESH_META), 0 if name == "root" else 1


def metadata_json(samples: DataFrame, **settings) -> DataFrame:
    """One row of JSON: settings, sample count and the label histogram."""
    hist = label_histogram(samples).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("label").cast("string"), "n")))).alias("label_hist"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
    given = [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    return hist.select(F.to_json(F.struct(*given, "samples", "label_hist")).alias("metadata"))
