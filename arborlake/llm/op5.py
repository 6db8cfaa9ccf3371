"""Query op5: the language of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import held_out, table
from arborlake.llm.langid import identify, learn_from


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_from(docs, held_out(F.col("doc_id")))
    found, label, score = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(label).alias("lang_pred"), F.col(score).alias("score"))
