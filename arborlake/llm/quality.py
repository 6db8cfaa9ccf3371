"""Quality rules: a base filter and an n-gram likelihood ratio (DataFrame functions only).

Every text's word unigrams and bigrams are hashed to ``BUCKETS`` buckets.  Two
multinomials are counted, one over all documents (the raw corpus) and one over
trusted ones; a document's verdict is the mean over its n-grams of
log(trusted / raw), kept if at least ``threshold``.  Counts cover all
documents; trusted rows are at most ``TRUSTED`` labelled ids, those with the
smallest hash, so their broadcast is bounded.  The weights, ``BUCKETS``
numbers, become a literal of the plan.

Repeated 3-word windows are found inside the row: window hashes with their
positions are sorted as plain longs, neighbours that share the hash's leading
bits are compared as text, and covered words are summed over the gaps between
the windows found.  Nothing is shuffled but the bucket counts.

Defined cases: a null or empty text has no words, all counts 0, score 0 and
fails the base rules; a very long text is one row, whose words and windows are
arrays of one task, so it takes some ten times its size there; without trusted rows all weights are 0; a null id is
never trusted; repeated rows agree; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import WORD, fresh, quoted

BUCKETS = 1 << 15
#: Bound of the sample of trusted ids.
TRUSTED = 20_000
#: Mean log-ratio from which a document is kept.
THRESHOLD = -0.06
SYMBOLS = "[#*$%&|<>]"
#: Low bits of a sort key that hold a window's position; a text of 2 GB has fewer words.
POSITION_BITS = 30


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def grams_of(words: Column) -> Column:
    """Buckets of unigrams, then of bigrams."""
    n = F.size(words)
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    double = F.transform(words, lambda w, i: F.when(i + 1 < n, F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(BUCKETS)).cast("int")).otherwise(-1))
    return F.filter(F.concat(single, double), lambda b: b >= 0)


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """At most ``TRUSTED`` distinct ids labelled 1, by smallest hash."""
    ids = labels.where((quoted(quality) == 1) & quoted(doc_id).isNotNull()).select(quoted(doc_id).alias("trusted_id")).distinct()
    return ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(TRUSTED)


def weights(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", smoothing: float = 1.0) -> list[float]:
    """log(trusted / raw) of every bucket; ``BUCKETS`` rows reach the driver."""
    rows = docs.select(quoted(doc_id).alias("id"), words_of(quoted(text)).alias("words"))
    rows = rows.join(F.broadcast(trusted), rows.id == F.col("trusted_id"), "left").select("words", F.col("trusted_id").isNotNull().cast("long").alias("t"))
    counts = rows.select("t", F.explode(grams_of(F.col("words"))).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("own"))
    raw, own = [smoothing] * BUCKETS, [smoothing] * BUCKETS
    for row in counts.collect():
        raw[row.b] += row.raw
        own[row.b] += row.own
    all_raw, all_own = sum(raw), sum(own)
    if all_own == smoothing * BUCKETS:
        return [0.0] * BUCKETS
    return [round(math.log(a / all_own) - math.log(b / all_raw), 5) for a, b in zip(own, raw, strict=True)]


def repeated_words(words: Column, sorted_keys: Column) -> Column:
    """Sort keys of windows whose hash prefix another window of the text has."""
    n = F.size(sorted_keys)
    top = lambda x: F.shiftright(x, POSITION_BITS)
    return F.filter(sorted_keys, lambda x, i: ((i > 0) & (top(x) == top(F.get(sorted_keys, i - 1)))) | ((i + 1 < n) & (top(x) == top(F.get(sorted_keys, i + 1)))))


def measure(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with counts, base_failed, score and kept; also the columns' names."""
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    names = dict(zip(keys, fresh(docs, *keys), strict=True))
    own = fresh(docs, "q_words", "q_lines", "q_sorted", "q_found", "q_places")
    w, lines, order, found, places = own
    base = [quoted(c) for c in docs.columns]
    body = F.coalesce(quoted(text), F.lit(""))
    low = (1 << POSITION_BITS) - 1
    words = quoted(w)

    out = docs.select(
        *base,
        words_of(quoted(text)).alias(w),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias(lines),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias(names["n_symbols"]),
    )
    kept = [*base, words, quoted(names["n_symbols"])]
    window = lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))
    key = F.transform(words, lambda x, i: F.when(i + 2 < F.size(words), window(x, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    out = out.select(
        *kept,
        (F.size(lines) - F.size(F.array_distinct(quoted(lines)))).cast("long").alias(names["n_dup_lines"]),
        F.sort_array(F.slice(key, 1, F.greatest(F.size(words) - 2, F.lit(0)))).alias(order),
    )
    kept.append(quoted(names["n_dup_lines"]))
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    exact = F.transform(repeated_words(words, quoted(order)), lambda x: F.struct(F.concat_ws(" ", F.get(words, at(x)), F.get(words, at(x) + 1), F.get(words, at(x) + 2)).alias("g"), at(x).alias("p")))
    out = out.select(*kept, F.sort_array(exact).alias(found))
    f = quoted(found)
    same = F.filter(f, lambda x, i: ((i > 0) & (x.g == F.get(f, i - 1).g)) | ((i + 1 < F.size(f)) & (x.g == F.get(f, i + 1).g)))
    out = out.select(*kept, F.sort_array(F.transform(same, lambda x: x.p)).alias(places))
    p = quoted(places)
    gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    n = F.size(words).cast("long")
    out = out.select(
        *kept,
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias(names["n_repeat_words"]),
        n.alias(names["n_words"]),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias(names["word_chars"]),
        F.when(n > 0, F.aggregate(grams_of(words), F.lit(0.0), lambda a, x: a + F.get(table, x)) / (2 * n - 1)).otherwise(F.lit(0.0)).alias(names["llr"]),
    )
    failed = (quoted(names["n_words"]) < 50) | (100 * quoted(names["n_repeat_words"]) > 50 * quoted(names["n_words"]))
    out = out.select(*base, *[quoted(names[k]) for k in keys if k not in ("base_failed", "kept")], failed.alias(names["base_failed"]))
    return out.withColumn(names["kept"], ~quoted(names["base_failed"]) & (quoted(names["llr"]) >= threshold)), names
