"""From raw documents to a tokenised training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  The stages' results are meant to be
written and read again between them; ``run`` cuts the lineage at files in the
shared checkpoint folder instead.

Defined cases, beside those of the operators: an empty table stays empty; texts
that are null or have no letter go in the first stage; rows with a null id are
kept like any other, one of each group of copies; repeated rows are copies of
each other, so one stays; extra columns pass all stages but the last, whatever
their names; a very long text stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.bpe import bpe_encode
from arborlake.llm.common import cut, held_out
from arborlake.llm.langid import identify, learn_from
from arborlake.llm.lsm import drop_duplicates
from arborlake.llm.mixing import mix
from arborlake.llm.op6 import tokenizer_path
from arborlake.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter go."""
    found, label, score = identify(docs, learn_from(docs, held_out(F.col("doc_id"))))
    return found.where(F.col(label) != "und").drop(label, score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the largest id, of each set of equal texts."""
    return drop_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near copies."""
    return keep_one(docs, words=4, radius=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text they spell."""
    encoded, names = bpe_encode(docs, tokenizer_path())
    return encoded.select("doc_id", "lang", "source", F.col(names["n"]).alias("n_tokens"), F.col(names["ids"]).alias("token_ids"), F.sha2(names["ids"], 256).alias("ids_sha256"), F.sha2(F.col(names["decoded"]).cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe_encode", encode)]

#: Naive Bayes, hashes of shingles and BPE are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
