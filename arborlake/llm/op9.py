"""Query op9: toxicity of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import held_out, table
from arborlake.llm.toxicity import learn, score, training_rows


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"))
    found, name = score(docs, learn(docs, training_rows(table(spark, sf_dir, "labels"), held)))
    return found.select("doc_id", held.alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.3).cast("int").alias("predicted"))
