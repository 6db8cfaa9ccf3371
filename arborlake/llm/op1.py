"""Query op1: quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm.common import table
from arborlake.llm.quality import measure, trusted_ids, weights


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = weights(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return measure(docs, model)[0].drop("text")
