"""Class weights: ones, a priori counts, or a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ones(samples: DataFrame) -> DataFrame:
    """Weight 1 for each class that occurs."""
    return samples.select("label").distinct().select("label", F.lit(1).cast("bigint").alias("w"))


def apriori(samples: DataFrame) -> DataFrame:
    """A class's count, which gives each class a total mass of 1."""
    return samples.groupBy("label").agg(F.count("*").alias("w"))


def from_file(spark: SparkSession, path: str, num_classes: int) -> DataFrame:
    """Pairs ``class weight`` of a text file; classes not listed weigh 1, others out of range are ignored.

    The last of several lines for one class counts.  A missing file is an error.
    """
    lines = spark.read.schema("label int, w bigint").csv(path, sep=" ", ignoreLeadingWhiteSpace=True)
    listed = lines.where(F.col("label").between(0, num_classes - 1)).withColumn("at", F.monotonically_increasing_id()).groupBy("label").agg(F.max_by("w", "at").alias("listed"))
    return spark.range(num_classes).select(F.col("id").cast("int").alias("label")).join(listed, "label", "left").select("label", F.coalesce("listed", F.lit(1)).cast("bigint").alias("w"))
