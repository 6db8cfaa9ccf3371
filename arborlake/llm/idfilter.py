"""A filter of ids with a fixed size, to spare a shuffle the rows it cannot need.

The filter only saves work: rows it admits by mistake are sorted out by the
join that follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the filter: 8 MB at most, whatever the number of ids.
WORDS = 1 << 20


def id_hash(doc_id: Column) -> Column:
    return F.xxhash64(doc_id, F.lit(77))


def build(ids: DataFrame, name: str) -> np.ndarray:
    """Words of the filter of column ``name``; at most ``WORDS`` rows reach the driver."""
    h = F.col("h")
    bits = [F.struct(F.pmod(F.shiftright(h, 6 + 20 * i), F.lit(WORDS)).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(h, {40 * i}), 64) as int))").alias("bit")) for i in range(2)]
    rows = ids.select(id_hash(F.col(name)).alias("h")).select(F.explode(F.array(*bits)).alias("x"))
    found = rows.groupBy("x.word").agg(F.bit_or("x.bit").alias("bits")).limit(WORDS).toArrow()
    words = np.zeros(WORDS, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return words


def admits(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (signed longs) the filter admits."""
    out = np.ones(len(hashes), bool)
    for i in range(2):
        word = (hashes >> (6 + 20 * i)) % WORDS
        bit = (hashes >> (40 * i)) % 64
        out &= (words[word] >> bit.astype(np.uint64) & np.uint64(1)).astype(bool)
    return out
