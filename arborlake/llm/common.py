"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regular expression of a word: a run without the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have (ignoring case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the session's folder, or a temporary one where the session is a single process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at files in the shared checkpoint folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of reduce tasks the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def one_row_each(docs: DataFrame, kept: DataFrame, doc_id: str, mark: str) -> DataFrame:
    """One row of ``docs``, without ``mark``, for each row (kept_id, kept_mark) of ``kept`` that has its id, nulls equal, and its mark.

    Of several such rows the one with the smallest hash of its columns stays.
    """
    key, place = fresh(docs, "id_key", "row_place")
    as_key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    kept = kept.select(as_key(F.col("kept_id")).alias("kept_key"), "kept_mark")
    found = docs.withColumn(key, as_key(quoted(doc_id))).join(kept, (quoted(key) == F.col("kept_key")) & (quoted(mark) == F.col("kept_mark")), "left_semi")
    order = Window.partitionBy(quoted(key), quoted(mark)).orderBy(F.xxhash64(*[quoted(c) for c in docs.columns]))
    return found.withColumn(place, F.row_number().over(order)).where(quoted(place) == 1).select(*[quoted(c) for c in docs.columns if c != mark])
