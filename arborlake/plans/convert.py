"""Depth frames to a training dataset: samples, threshold metadata, probe coordinates and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators.datasets import metadata_json
from arborlake.operators.depth import depth_features, probe_coords
from arborlake.operators.thresholds import threshold_metadata
from arborlake.schema import feature_type
from arborlake.sources import tables


def convert(spark: SparkSession, frames: DataFrame, path: str, num_features: int = 200, probe_size: float = 50.0, type_name: str = "F_CHAR", seed: int = 0, samples_per_frame: int | None = None, overwrite: bool = False) -> DataFrame:
    """Write ``samples`` (their frame is the pose), ``thresholds``, ``coords`` and ``metadata`` below ``path``; returns the metadata.

    Features are computed once, by the write of the samples; all else reads what was written.
    A dataset that is there already is an error unless ``overwrite``.
    """
    coords, top = probe_coords(num_features, probe_size, seed), feature_type(type_name)[3]
    tables.write_samples(depth_features(frames, coords, type_name, samples_per_frame, seed), f"{path}/samples", overwrite)
    samples = spark.read.parquet(f"{path}/samples")
    values = samples.select(F.transform("features", lambda x: x.cast("float")).alias("features"))
    threshold_metadata(values, max_proxy=top, sentinel=top).write.mode("overwrite").parquet(f"{path}/thresholds")
    spark.createDataFrame(coords, "feature_id int, dr1 double, dc1 double, dr2 double, dc2 double").write.mode("overwrite").parquet(f"{path}/coords")
    settings = {"features": num_features, "feature_type": type_name, "probe_size": probe_size, "seed": seed, "samples_per_frame": samples_per_frame}
    metadata_json(samples, **settings).write.mode("overwrite").text(f"{path}/metadata")
    return spark.read.text(f"{path}/metadata").withColumnRenamed("value", "metadata")
