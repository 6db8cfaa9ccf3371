"""Exact deduplication with a log-structured merge index.

1. *Memtables.*  Each task hashes normalised texts into a memtable.  A digest
   already there is a hit and its bytes are compared at once.  A full memtable
   is flushed as a run: per digest prefix one segment of sorted digests, their
   counts and a Bloom filter.
2. *Compaction.*  The segments of a prefix meet in one task and are merged,
   smallest first.  Only digests that the larger run's filter admits are
   searched in it.  Digests counted twice or more are hits.
3. *Verification.*  Hits set bits of one filter of fixed size, which travels to
   all executors.  A second scan passes it; texts it admits are grouped in
   memtables again, one representative a memtable and text is shuffled by
   digest, and the bytes of representatives are compared.  So a text that a
   third of all rows share crosses the network once a memtable, and texts whose
   digests agree but whose bytes differ end in different groups.

Defined cases: a null text counts as empty; a very long text is hashed and
compared whole, and may make a memtable larger than its bound by its own size;
rows with a null id count in a
group but do not give its identifier, unless all are null; if several rows
have the identifier that stays, exactly one of them is marked kept; an empty
table gives an empty result; the input's other columns, whatever their names,
are not touched.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import cut, fresh, one_row_each, quoted, shuffle_partitions

#: Bytes of distinct text that a memtable holds before it is flushed.
MEMTABLE_BYTES = 48 << 20
#: Entries, so that many short texts do not pile up.
MEMTABLE_ROWS = 400_000
#: Bits of the filter of hits: 8 MB at most, whatever the input.
HIT_BITS = 1 << 26
#: Bits per digest of a segment's filter.
SEGMENT_BITS = 12


def normalise(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def probes(digests: np.ndarray, bits: int, n: int = 3) -> np.ndarray:
    """Bit positions (n x digests) of digests in a filter of ``bits`` bits."""
    raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), digests.dtype.itemsize)
    wide = np.zeros((len(raw), 16), np.uint8)
    wide[:, : min(16, raw.shape[1])] = raw[:, :16]
    a, b = np.ascontiguousarray(wide).view(np.uint64).T
    with np.errstate(over="ignore"):
        mixed = [(a + np.uint64(i) * (b | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) for i in range(1, n + 1)]
    return np.stack([(x >> np.uint64(11)) % np.uint64(bits) for x in mixed])


class Run:
    """Sorted digests with counts and a filter."""

    def __init__(self, digests: np.ndarray, counts: np.ndarray, bits: np.ndarray | None = None):
        self.digests, self.counts = digests, counts
        if bits is None:
            bits = np.zeros(max(64, SEGMENT_BITS * len(digests)), bool)
            bits[probes(digests, len(bits)).ravel()] = True
        self.bits = bits

    def __lt__(self, other: Run) -> bool:
        return len(self.digests) < len(other.digests)

    def merge(self, small: Run) -> Run:
        """Both runs as one; the smaller one's digests pass this one's filter before they are searched."""
        maybe = np.flatnonzero(self.bits[probes(small.digests, len(self.bits))].all(axis=0))
        at = np.minimum(np.searchsorted(self.digests, small.digests[maybe]), len(self.digests) - 1)
        same = self.digests[at] == small.digests[maybe]
        counts = self.counts.copy()
        counts[at[same]] += small.counts[maybe[same]]
        new = np.ones(len(small.digests), bool)
        new[maybe[same]] = False
        where = np.searchsorted(self.digests, small.digests[new])
        return Run(np.insert(self.digests, where, small.digests[new]), np.insert(counts, where, small.counts[new]))


def compact(runs: list[Run]) -> Run:
    """Size-tiered: the two smallest runs are merged until one is left."""
    heapq.heapify(runs)
    while len(runs) > 1:
        small = heapq.heappop(runs)
        heapq.heappush(runs, heapq.heappop(runs).merge(small))
    return runs[0]


class Memtable:
    """digest -> classes of rows whose bytes are equal."""

    def __init__(self):
        self.entries: dict[bytes, list[list]] = {}
        self.held = self.rows = 0

    def add(self, digest: bytes, body: bytes) -> list:
        """The class of ``body``: a list that starts with its bytes."""
        classes = self.entries.setdefault(digest, [])
        for found in classes:
            if found[0] == body:
                return found
        classes.append(found := [body])
        self.held += len(body)
        self.rows += 1
        return found

    def full(self) -> bool:
        return self.held >= MEMTABLE_BYTES or self.rows >= MEMTABLE_ROWS


def hit_filter(docs: DataFrame, text: str, digest_bytes: int) -> dict[int, int]:
    """Non-zero 64-bit words of the filter of digests that two or more rows have."""
    parts, width = shuffle_partitions(docs.sparkSession), digest_bytes

    def flush(table: Memtable):
        digests = np.array(sorted(table.entries), f"S{width}")
        counts = np.array([sum(c[1] for c in table.entries[d]) for d in sorted(table.entries)], np.int64)
        prefix = np.frombuffer(digests.tobytes(), np.uint8).reshape(-1, width)[:, : min(4, width)].astype(np.int64)
        prefix = (prefix * 256 ** np.arange(prefix.shape[1])[::-1]).sum(axis=1) * parts >> (8 * prefix.shape[1])
        edges = np.flatnonzero(np.diff(prefix, prepend=-1))
        for i, j in zip(edges, [*edges[1:], len(digests)], strict=True):
            run = Run(digests[i:j], counts[i:j])
            yield int(prefix[i]), run.digests.tobytes(), run.counts.tobytes(), np.packbits(run.bits).tobytes(), len(run.bits)

    def segments(batches):
        names = ["prefix", "digests", "counts", "filter", "bits"]
        table = Memtable()
        for batch in batches:
            for body in batch.column(0):
                body = normalise(body.as_py())
                found = table.add(hashlib.sha256(body).digest()[:width], body)
                found[1:] = [found[1] + 1 if len(found) > 1 else 1]
                if table.full():
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*flush(table), strict=True)), strict=True)), schema=layout)
                    table = Memtable()
        if table.entries:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*flush(table), strict=True)), strict=True)), schema=layout)

    def merge(batches):
        runs: dict[int, list[Run]] = {}
        for batch in batches:
            for prefix, digests, counts, bits, n in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                own = runs.setdefault(prefix, [])
                own.append(Run(np.frombuffer(digests, f"S{width}"), np.frombuffer(counts, np.int64), np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)))
        for own in runs.values():
            run = compact(own)
            at = np.unique(probes(run.digests[run.counts > 1], HIT_BITS).ravel())
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    layout = pa.schema([("prefix", pa.int64()), ("digests", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary()), ("bits", pa.int64())])
    runs = docs.select(quoted(text)).mapInArrow(segments, "prefix bigint, digests binary, counts binary, filter binary, bits bigint")
    hits = runs.repartition(parts, "prefix").mapInArrow(merge, "word bigint, bits bigint")
    words = hits.groupBy("word").agg(F.bit_or("bits").alias("bits")).limit(HIT_BITS // 64).toArrow()
    return dict(zip(words["word"].to_pylist(), words["bits"].to_pylist(), strict=True))


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest", digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest id of equal texts stays.
    ``digest_bytes`` shortens the index's digests (results do not depend on it).
    """
    spark, id_type = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    best = {"smallest": min, "largest": max}[keep]
    found = hit_filter(docs, text, digest_bytes)
    words = np.zeros(HIT_BITS // 64, np.uint64)
    words[list(found)] = np.array(list(found.values()), np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(words if found else None)
    width = digest_bytes

    def candidates(batches):
        """Row (leads says whether it would stay in its class), then a row for each class with its bytes."""
        from pyspark import TaskContext

        words, table, rows, serial = shared.value, Memtable(), [], TaskContext.get().partitionId() << 40
        layout = None

        def flush(rows, table):
            classes = []
            for digest, own in table.entries.items():
                for body, cls, ids in own:
                    known = [x for x, _ in ids if x is not None]
                    top = best(known) if known else None
                    lead = next(row for x, row in ids if x == top)
                    lead[3] = True
                    classes.append([top, None, cls, False, len(ids), digest, body])
            for x in rows:
                x += [None, None, None]
            rows += classes
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 5000], strict=True), layout.types, strict=True)], schema=layout)

        for batch in batches:
            layout = layout or pa.schema([("doc_id", batch.schema.field(0).type), ("sha", pa.string()), ("cls", pa.int64()), ("leads", pa.bool_()), ("n", pa.int64()), ("digest", pa.binary()), ("body", pa.binary())])
            bodies = [normalise(x.as_py()) for x in batch.column(1)]
            digests = [hashlib.sha256(x).digest() for x in bodies]
            maybe = np.zeros(len(bodies), bool)
            if words is not None and bodies:
                at = probes(np.array([d[:width] for d in digests], f"S{width}"), HIT_BITS)
                maybe = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool).all(axis=0)
            for x, body, digest, hit in zip(batch.column(0).to_pylist(), bodies, digests, maybe, strict=True):
                row = [x, digest.hex(), None, True]
                if hit:
                    own = table.add(digest[:width], body)
                    if len(own) == 1:
                        own += [serial, []]
                        serial += 1
                    row[2:] = [own[1], False]
                    own[2].append((x, row))
                rows.append(row)
                if table.full() or len(rows) >= MEMTABLE_ROWS:
                    yield from flush(rows, table)
                    rows, table = [], Memtable()
        if rows:
            yield from flush(rows, table)

    def verify(batches):
        """Classes of one digest, sorted: those with equal bytes become one group."""

        def classes():
            for batch in batches:
                yield from zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)

        out, layout = [], None
        for _, own in groupby(classes(), key=lambda x: x[0]):
            groups: list[list] = []  # one but for colliding digests
            for _, body, cls, n, top in own:
                group = next((g for g in groups if g[0] == body), None)
                if group is None:
                    groups.append(group := [body, []])
                group[1].append((cls, n, top))
            for _, members in groups:
                known = [top for _, _, top in members if top is not None]
                keep_id, size = best(known) if known else None, sum(n for _, n, _ in members)
                first = min(cls for cls, _, top in members if top == keep_id)
                out += [(cls, keep_id, size, cls == first) for cls, _, _ in members]
            if len(out) >= 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows):
        cls, keep_id, size, first = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(keep_id, pa_type), pa.array(size, pa.int64()), pa.array(first, pa.bool_())], names=["cls", "keep_id", "group_size", "first"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_type = to_arrow_type(docs.schema[doc_id].dataType)
    both = cut(docs.select(quoted(doc_id), quoted(text)).mapInArrow(candidates, f"doc_id {id_type}, sha string, cls bigint, leads boolean, n bigint, digest binary, body binary"))
    classes = both.where("body is not null").select("digest", "body", "cls", "n", "doc_id")
    groups = classes.repartition(shuffle_partitions(spark), "digest").sortWithinPartitions("digest").mapInArrow(verify, f"cls bigint, keep_id {id_type}, group_size bigint, first boolean")
    rows = both.where("body is null").join(groups, "cls", "left")
    return rows.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("leads") & F.coalesce("first", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each set of equal texts, null and repeated ids included."""
    kept = mark_duplicates(docs, doc_id=doc_id, text=text, **options).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_mark"))
    mark = fresh(docs, "text_sha256")[0]
    body = F.coalesce(quoted(text), F.lit(""))
    # as normalise; lower() is faster, and the same on ASCII
    plain = F.when(F.octet_length(body) == F.char_length(body), F.lower(body)).otherwise(F.translate(body, ascii_uppercase, ascii_lowercase))
    return one_row_each(docs.withColumn(mark, F.sha2(plain.cast("binary"), 256)), kept, doc_id, mark)
