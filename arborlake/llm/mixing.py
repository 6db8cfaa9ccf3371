"""Mixing sources to target weights (DataFrame functions only).

Words are counted per source, each source gets a target by water-filling under
a cap, and every document is emitted ``floor(rate)`` times plus one Bernoulli
copy, seeded by a hash of its id, with the rate's fraction as probability.

Defined cases: a null text has size 0; a very long text is one row like any
other, counted in place; a null source is a source of its own,
placed last; rows with equal ids draw alike; a null id draws as the text
``null``; an empty table gives an empty result; a source without words has
target 0.  Columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.common import WORD, fresh, quoted

#: A table of at most this many sources is sent to all executors; a longer one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with ``target``, one row a source.

    Ordered by cap over weight, capped sources come first; the water level after
    k capped sources is (total - their caps) / (weights left), which rises while
    sources are capped and falls after, so its maximum is the level sought.  The
    windows run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least("most", F.col("w") * F.col("level")).alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1): 52 bits of the MD5 of seed and id, so any SQL engine can repeat it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mixing_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target and copies; and the names of these columns.

    The per-source table is computed first.  Only if it has at most
    ``BROADCAST_SOURCES`` rows does it travel to every executor; otherwise the
    join shuffles and adaptive execution splits a hot source.
    """
    spark = docs.sparkSession
    key, size, source_size, target, copies = fresh(docs, "mix_source", "mix_size", "mix_source_size", "mix_target", "mix_copies")
    sizes = docs.select(quoted(source).alias("source"), word_count(quoted(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    few = targets.limit(BROADCAST_SOURCES + 1).collect()
    if len(few) <= BROADCAST_SOURCES:
        targets = F.broadcast(spark.createDataFrame(few, targets.schema))
    targets = targets.toDF(key, source_size, target)
    joined = docs.withColumn(size, word_count(quoted(text))).join(targets, quoted(source).eqNullSafe(quoted(key)), "left").drop(key)
    rate = F.when(quoted(source_size) > 0, quoted(target) / quoted(source_size)).otherwise(F.lit(0.0))
    extra = (draw(quoted(doc_id), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(copies, F.floor(rate) + extra), {"size": size, "source_size": source_size, "target": target, "copies": copies}


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    plan, names = mixing_plan(docs, **options)
    times = fresh(plan, "mix_copy")[0]
    repeated = plan.withColumn(times, F.explode(F.array_repeat(F.lit(0), quoted(names["copies"]).cast("int"))))
    return repeated.select(*[quoted(c) for c in docs.columns])
