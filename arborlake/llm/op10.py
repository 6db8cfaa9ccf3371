"""Query op10: passages that documents repeat."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import table
from arborlake.llm.prefixfree import remove_repeats


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x.end - x.start)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"))
