"""Query op6: BPE over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.bpe import bpe_encode
from arborlake.llm.common import table


def tokenizer_path() -> str:
    """The public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, n = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return encoded.select("doc_id", F.col(n["n"]).alias("n_tokens"), F.sha2(n["ids"], 256).alias("ids_sha256"), F.sha2(F.col(n["decoded"]).cast("binary"), 256).alias("decoded_sha256"))
