"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are majority votes over the 64 bits of every word shingle's
XXH64.  Distinct fingerprints within ``radius`` bits are found exactly: of B
bands of bits, a linked pair agrees in at least B - radius, so it meets in a
bucket of some choice of B - radius bands.  B follows from the number of
fingerprints, so a bucket stays short while tables grow few.

In a bucket bits are stored vertically: plane j holds bit j of all members.
A query's differences are added plane by plane into carry-save counters, one
machine word for 64 members, and a block is abandoned once all its counters
exceed the radius; many queries and blocks are swept together.  A bucket yields edges of a spanning forest, at most one a
member, never its pairs.  Long buckets are cut into chunks and each pair of
chunks is a task of its own.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; a very long text is hashed whole, its bits counted ``COUNTED`` shingles at
a time; extra columns keep their values, whatever their names; a text of fewer words than a shingle is one shingle; rows with a null id
take part in links but cannot name a component, unless no row of it has an id
(then null); repeated rows agree; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.common import cut, fresh, one_row_each, quoted, shuffle_partitions
from arborlake.llm.graph import connected_components

#: Members of a bucket that one task compares with each other.
CHUNK = 16_384
#: Rows of whole buckets that are laid out in planes together, at least.
GATHERED = 32_768
#: Comparisons of a query with 64 lanes made at once.
COMPARED = 1 << 17
SEED = 42
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def fingerprint(text: str | None, words: int) -> int:
    """Majority of the hashes of all shingles; 0 without a word."""
    import xxhash

    body = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not body:
        return 0
    joined, n = memoryview(b" ".join(body)), len(body)
    if n <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in body])
        starts = np.concatenate([[0], ends[: n - words]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, n - words + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4) -> tuple[DataFrame, str]:
    """``docs`` with a fingerprint (64 bits as a signed long); also the column's name."""
    name = fresh(docs, "simhash")[0]
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])), name


def exceeds(counters: np.ndarray, radius: int) -> np.ndarray:
    """Mask of the lanes whose counter is above ``radius``, compared from the highest bit."""
    greater = np.zeros(counters.shape[1], np.uint64)
    equal = ~greater
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            greater |= equal & counters[k]
            equal = equal & ~counters[k]
    return greater


def within(planes: np.ndarray, valid: np.ndarray, queries: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare query i with the 64 lanes of block ``blocks[i]``, for all i at once.

    Each plane's difference is added to carry-save counters; every eight planes
    the comparisons whose lanes all exceed the radius are abandoned.  Returns
    the comparisons left and their masks of lanes within the radius.
    """
    left, width = np.arange(len(queries)), (radius + 1).bit_length()
    counters, over = np.zeros((width, len(queries)), np.uint64), np.zeros(len(queries), np.uint64)
    for j in range(64):
        carry = planes[j][blocks] ^ (np.uint64(0) - (queries >> np.uint64(j) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry  # a counter that overflows stays over
        if j % 8 == 7:
            near = ~(over | exceeds(counters, radius)) & valid[blocks]
            go_on = np.flatnonzero(near)
            if len(go_on) < len(left):
                left, queries, blocks, over, near = left[go_on], queries[go_on], blocks[go_on], over[go_on], near[go_on]
                counters = np.ascontiguousarray(counters[:, go_on])
    return left, near


class Forest:
    """Joins positions; knows which links were needed."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take links (a[i], b[i]): in each round every label takes its first link to another one."""
        while True:
            x, y = self.label[a], self.label[b]
            other = x != y
            a, b, x, y = a[other], b[other], x[other], y[other]
            if not len(a):
                return
            root: dict[int, int] = {}

            def find(i: int, root: dict[int, int] = root) -> int:
                while (up := root.get(i, i)) != i:
                    root[i] = root.get(up, up)
                    i = up
                return i

            for i in np.unique(y, return_index=True)[1].tolist():
                if (p := find(int(x[i]))) != (q := find(int(y[i]))):
                    root[q] = p
                    self.edges.append((int(a[i]), int(b[i])))
            to = np.arange(len(self.label))
            to[list(root)] = [find(i) for i in list(root)]
            self.label = to[self.label]


def linked(values: np.ndarray, starts: np.ndarray, second: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions (i, j) of links that span all links inside each group.

    Groups begin at ``starts``.  Where a group has members with ``second`` set,
    only links between these and its others count.
    """
    n, ends = len(values), np.append(starts[1:], len(values))
    order = np.lexsort((second, np.repeat(np.arange(len(starts)), ends - starts)))  # stable within a group
    firsts = np.add.reduceat(~second, starts) if n else np.empty(0, int)
    place, target, first_block, blocks = [], [], [], 0
    q_at, q_from, q_to = [], [], []
    for start, end, k in zip(starts.tolist(), ends.tolist(), firsts.tolist(), strict=True):
        own = order[start:end]
        kind = (0 < k < len(own)) or k == 0  # a pair of chunks, of which one may be empty
        members = own[k:] if kind else own
        queries = own[:k] if kind else own
        if len(queries) and len(members) and len(own) > 1:
            lanes = blocks * 64 + np.arange(len(members))
            place.append(lanes)
            target.append(members)
            last = blocks + -(-len(members) // 64)
            q_at.append(queries)
            q_from.append(np.full(len(queries), blocks) if kind else lanes // 64)  # a pair of a group is compared once
            q_to.append(np.full(len(queries), last))
            blocks = last
    forest = Forest(n)
    if not blocks:
        return []
    place, target, q_at, q_from, q_to = map(np.concatenate, (place, target, q_at, q_from, q_to))
    member = np.full(blocks * 64, -1)
    member[place] = target
    laid = np.zeros(blocks * 64, np.uint64)
    laid[place] = values[target]
    bits = np.unpackbits(laid.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)
    valid = np.packbits(member >= 0, bitorder="little").view(np.uint64)
    counts = q_to - q_from
    done = np.concatenate([[0], np.cumsum(counts)])
    i = 0
    while i < len(q_at):
        j = max(i + 1, int(np.searchsorted(done, done[i] + COMPARED, "right")) - 1)
        which = np.repeat(np.arange(i, j), counts[i:j])
        block = np.arange(len(which)) - (done[which] - done[i]) + q_from[which]
        left, near = within(planes, valid, values[q_at[which]], block, radius)
        hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        of = left[hit // 64]
        a, b = q_at[which[of]], member[block[of] * 64 + hit % 64]
        forest.add(a[a != b], b[a != b])
        i = j
    return forest.edges


def bands(n: int, radius: int) -> int:
    """Bands so that the agreeing ones have about log2(n) bits."""
    b = radius + 1
    while b < 2 * radius and 64 * (b - radius) / b < np.log2(max(n, 2)):
        b += 1
    return b


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (a, b) that connect all within ``radius``."""
    spark = prints.sparkSession
    n = prints.count()
    b = bands(n, radius)
    cuts = [64 * i // b for i in range(b + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(b), b - radius)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(table).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")))
    spread = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", F.xxhash64("key.t", "key.k").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    members = spread.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # every pair of chunks is a group: (own, other) in order
    dealt = members.select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), (F.col("own") > F.col("other")).alias("second"))

    def compare(batches):
        kept: list = []
        held = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                kept.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
                held += batch.num_rows
                if held < GATHERED:
                    continue
            if not held:
                continue
            grp, fp, second = (np.concatenate(x) for x in zip(*kept, strict=True))
            whole = len(grp) if batch is None else int(np.searchsorted(grp, grp[-1]))  # the last group may go on
            kept, held = [[grp[whole:], fp[whole:], second[whole:]]], len(grp) - whole
            grp, fp, second = grp[:whole], fp[:whole], second[:whole]
            if whole:
                pairs = linked(fp.view(np.uint64), np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])), second, radius)
                at = np.array(pairs, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(fp[at[:, 0]]), pa.array(fp[at[:, 1]])], names=["a", "b"])

    return dealt.repartition(shuffle_partitions(spark), "grp").sortWithinPartitions("grp").select("grp", "fp", "second").mapInArrow(compare, "a bigint, b bigint")


def rooted(rows: DataFrame, radius: int) -> DataFrame:
    """(doc_id, simhash) -> fp, least (smallest id that has it), root: one row a fingerprint, with its component."""
    prints = cut(rows.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(prints.select("fp"), radius))
    return prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, simhash, component_id (smallest id that links reach)."""
    found, name = fingerprints(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), "text", words)
    rows = cut(found.select("doc_id", F.col(name).alias("simhash")))
    of = rooted(rows, radius)
    # cut, so that the join has a shuffle of its own on both sides and a giant component can be split
    names = cut(of.groupBy("root").agg(F.min("least").alias("component_id")))
    of = of.join(names, "root").select("fp", "component_id")
    return rows.join(of, rows.simhash == of.fp).select("doc_id", "simhash", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: one with the smallest id, or without an id where none has one."""
    found, mark = fingerprints(docs, text, words)
    rows = cut(found)  # whole rows, so that the marks are those of the rows that stay
    of = rooted(rows.select(quoted(doc_id).alias("doc_id"), quoted(mark).alias("simhash")), radius)
    lead = of.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("lead"))
    return one_row_each(rows, lead.select(F.col("lead.least").alias("kept_id"), F.col("lead.fp").alias("kept_mark")), doc_id, mark)
