"""Query op3: licences of all documents, laid out as files in a folder for each source."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import table
from arborlake.llm.licenses import scan


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", F.lit("corpus"), F.coalesce("source", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return scan(docs)[0].select("doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "license_from")
