"""Removal of repeated passages by prefix-free parsing.

A byte is removed if a ``length``-byte string over it also starts in a document
with a smaller id.

*Parse.*  The trigger of a ``length``-byte string is the least rolling hash of
its windows of ``TRIGGER`` bytes.  A phrase is a run of neighbouring strings
with one trigger, from its first string's first byte to its last one's last
byte.  So every string starts in exactly one phrase and lies in it, and where
phrases begin depends on the bytes around alone: equal passages have equal
phrases, and equal strings equal triggers.

*Blocks.*  Texts are packed into blocks of some megabytes, compressed and
written once, so that all later steps find the same places in them.  A block has
its own dictionary: its distinct phrases, each with the smallest id that has it.

*Dictionary and corpus order.*  Blocks send their triggers (32 bits each beside
the part they are dealt to) and learn which ones other blocks have.  Phrases of
shared triggers are dealt by trigger, each once a block.  A part drops equal
phrases, which leaves its dictionary, and sorts the dictionary's suffixes of
``length`` bytes and more that another phrase may have: the suffix array of the
dictionary.  Neighbours with equal first ``length`` bytes form a class, whose
smallest document comes from the ids of its phrases, that is from where the
parse has them.  The order of suffixes beyond ``length`` bytes, which a suffix
array of the parse would give, cannot change a class and is not built.  Blocks
get one bit a string back: whether a smaller document has it.

Hashes only choose where strings meet and what is worth sorting: phrases and
strings count as equal if their bytes are.  Phrases of a trigger with more than
``HOT`` phrases are cut into their strings, which are dealt each by its own
hash, so that a common line in many surroundings does not gather in one task.

Defined cases: a null text is empty; a text shorter than ``length`` loses
nothing; a very long text is a block of its own, hashed piece by piece, and one
task holds it; rows with a null id neither lose bytes nor cause losses; rows
with equal ids do not affect each other; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import cut, quoted, shuffle_partitions

TRIGGER = 20
#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 8 << 20
#: Starts hashed at once, and phrases whose bytes are looked at together.
PIECE, GATHERED = 1 << 20, 1 << 14
#: Phrases of one trigger that are compared in one place.
HOT = 2_048
#: Parts that a task works through one after the other.
PARTS = 4
#: Bytes of texts in one batch of results.
BATCH_BYTES = 16 << 20
_RANDOM = np.random.default_rng(50)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RANDOM.integers(0, 1 << 63, 8, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _RANDOM.integers(0, 1 << 63, 64, np.int64).view(np.uint64)

BLOCKS = "block bigint, ids binary, known binary, sizes binary, raw bigint, body binary"
#: What a block learns: KNOWN triggers (shared, then hot ones), or bits of the strings it sent.
ANSWERS = "block bigint, part int, kind int, data binary"
KNOWN, BITS = 0, 1
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of ``k`` bytes (along the last axis), by doubling."""
    h, n, i = _BYTE[x], 1, 0
    while 2 * n <= k:
        h = h[..., :-n] * _STEP[i] + h[..., n:]
        n, i = 2 * n, i + 1
    if n < k:
        h = h[..., : n - k] * _STEP[i] + h[..., k - n :]
    return mixed(h)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return mixed(mixed(wide.view(np.uint64) ^ _WORD[: wide.shape[1] // 8]).sum(axis=1, dtype=np.uint64))


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by doubling."""
    n = 1
    while 2 * n <= w:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: n - w], h[w - n :]) if n < w else h


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def bounds(at: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Begin and end of the runs that begin at ``at``."""
    ends = np.append(at[1:], n) if len(at) else at
    return list(zip(at.tolist(), ends.tolist(), strict=True))


def counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[i] - 1 for each i, in a row."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Mask of the places in spans of which less than 100 overlap anywhere."""
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def least_of(cls: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of each of ``n`` classes, none of them empty."""
    order = np.argsort(cls, kind="stable")
    return np.minimum.reduceat(value[order], runs(cls[order])) if n else value[:0]


def distinct(hashes: np.ndarray, rows: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each row, a row of each class): equal are rows whose bytes, not only hashes, agree.

    ``rows`` gives the bytes at some positions, one row each.
    """
    order = np.argsort(hashes, kind="stable")
    at = runs(hashes[order])
    size = np.diff(np.append(at, len(order)))
    cls, first = np.empty(len(order), np.int64), order[at]
    cls[order] = np.repeat(np.arange(len(at)), size)
    again = np.flatnonzero(first[cls] != np.arange(len(order))) if len(order) else order
    bad = [part[(rows(part) != rows(first[cls[part]])).any(axis=1)] for part in np.split(again, range(GATHERED, len(again), GATHERED))]
    bad, found, extra = np.concatenate(bad), {}, []
    for i, own in zip(bad.tolist(), rows(bad), strict=True):  # different bytes with one hash
        key = own.tobytes()
        if key not in found:
            found[key] = len(first) + len(extra)
            extra.append(i)
        cls[i] = found[key]
    return cls, np.append(first, extra).astype(np.int64)


def parse(x: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the texts at ``begin`` with ``size`` bytes: first string's place, number of strings, trigger."""
    w = length - TRIGGER + 1
    whole = size >= length
    begin, last = begin[whole], begin[whole] + size[whole] - length
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if not len(begin):
        return none
    edge = np.zeros(len(x) + 1, np.int8)
    edge[begin] += 1
    edge[last + 1] -= 1
    valid = np.cumsum(edge, dtype=np.int8).view(bool)
    at, triggers, before = [], [], np.uint64(0)
    for i in range(0, len(x) - length + 1, PIECE):
        j = min(i + PIECE, len(x) - length + 1)
        low = sliding_least(gram_hashes(x[i : j + length - 1], TRIGGER), w)
        new = np.append(before, low[:-1]) != low
        new[1:] |= ~valid[i : j - 1]
        new[0] |= i == 0 or not valid[i - 1]
        found = np.flatnonzero(new & valid[i:j])
        at.append(found + i)
        triggers.append(low[found])
        before = low[-1]
    at, triggers = np.concatenate(at), mixed(np.concatenate(triggers))  # minima are small; parts are dealt by the leading bits
    end = last[np.searchsorted(begin, at, "right") - 1] + 1
    count = np.minimum(np.append(at[1:], len(x)), end) - at
    parts = -(-count // w)  # a run can be longer where bytes repeat
    if (parts > 1).any():
        step = counted(parts) * w
        at, triggers, count = np.repeat(at, parts) + step, np.repeat(triggers, parts), np.minimum(np.repeat(count, parts) - step, w)
    return at, count, triggers


class Block:
    """Texts, their phrases and their dictionary."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, body: bytes, length: int, parts: int):
        self.length, self.parts, self.width = length, parts, 2 * length - TRIGGER
        self.ids, self.known, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(known, bool), np.frombuffer(sizes, "<i8")
        self.x = np.frombuffer(body, np.uint8)
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1  # a byte lies between texts
        self._wide = np.append(self.x, np.zeros(self.width, np.uint8))
        self.at, self.count, trigger = parse(self.x, self.begin, np.where(self.known, self.sizes, 0), length)
        self.doc = self.ids[np.searchsorted(self.begin, self.at, "right") - 1]
        hashes = [row_hashes(self.rows(np.arange(i, min(i + GATHERED, len(self.at))))) for i in range(0, len(self.at), GATHERED)]
        self.cls, self.first = distinct(np.concatenate([np.empty(0, np.uint64), *hashes]), self.rows)
        self.least = least_of(self.cls, self.doc, len(self.first))
        trigger = trigger[self.first]
        part = (trigger >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        #: Part and 32 bits of the distinct triggers; of each class, and classes of each.
        self.keys, self.key, self.classes = np.unique(part << np.uint64(32) | trigger & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)

    def rows(self, phrases: np.ndarray) -> np.ndarray:
        """Bytes of phrases, padded, after their numbers of strings."""
        out = np.empty((len(phrases), self.width + 1), np.uint8)
        out[:, 0] = self.count[phrases]
        out[:, 1:] = np.lib.stride_tricks.sliding_window_view(self._wide, self.width)[self.at[phrases]]
        out[:, 1:][np.arange(self.width) >= self.count[phrases][:, None] + self.length - 1] = 0
        return out

    def strings(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.x, self.length)[at] if len(at) else np.empty((0, self.length), np.uint8)

    def listed(self) -> Iterator[tuple[int, bytes]]:
        """(part, triggers): a trigger as often as it has phrases."""
        every = np.repeat(self.keys, self.classes)
        part = (every >> np.uint64(32)).astype(np.int64)
        for i, j in bounds(runs(part), len(part)):
            yield int(part[i]), every[i:j].astype("<u4").tobytes()

    def entries(self, answers: list[tuple[int, bytes]]) -> None:
        """Choose what is compared with other blocks: phrases of shared triggers, or the strings of hot ones.

        ``part``, ``counts`` and ``docs`` tell of each entry where it goes, its
        number of strings and its smallest document here.
        """
        shared, hot = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        of = (self.keys >> np.uint64(32)).astype(np.int64)
        for part, data in answers:
            i, j = np.searchsorted(of, [part, part + 1])
            shared[i:j], hot[i:j] = np.unpackbits(np.frombuffer(data, np.uint8).reshape(2, -1), axis=1, count=j - i).astype(bool)
        sent = (shared | (self.classes > 1))[self.key]
        self.whole = np.flatnonzero(sent & ~hot[self.key])
        self.split = np.flatnonzero(sent & hot[self.key])
        n = self.count[self.first[self.split]]
        self.places = np.repeat(self.at[self.first[self.split]], n) + counted(n)
        hashes = np.concatenate([np.empty(0, np.uint64), *(row_hashes(self.strings(p)) for p in np.split(self.places, range(GATHERED, len(self.places), GATHERED)))])
        self.string, self.string_at = distinct(hashes, lambda i: self.strings(self.places[i]))
        self.string_least = least_of(self.string, np.repeat(self.least[self.split], n), len(self.string_at))
        dealt = (hashes[self.string_at] >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)
        part = np.concatenate([of[self.key[self.whole]], dealt.astype(np.int64)])
        self.order = np.argsort(part, kind="stable")
        self.part = part[self.order]
        self.counts = np.concatenate([self.count[self.first[self.whole]], np.ones(len(self.string_at), np.int64)])[self.order]
        self.docs = np.concatenate([self.least[self.whole], self.string_least])[self.order]

    def sent(self) -> Iterator[tuple]:
        """(part, counts, docs, bytes) of the entries."""
        for i, j in bounds(runs(self.part), len(self.part)):
            own = self.order[i:j]
            at = np.where(own < len(self.whole), self.at[self.first[self.whole[np.minimum(own, len(self.whole) - 1)]]] if len(self.whole) else 0, 0)
            strings = own >= len(self.whole)
            at[strings] = self.places[self.string_at[own[strings] - len(self.whole)]]
            n = self.counts[i:j]
            take = np.arange(self.width) < n[:, None] + self.length - 1
            yield int(self.part[i]), n.astype("u1").tobytes(), self.docs[i:j].astype("<i8").tobytes(), np.lib.stride_tricks.sliding_window_view(self._wide, self.width)[at][take].tobytes()

    def removed(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Mask of the removed bytes, from bits of the entries' strings."""
        ends = np.cumsum(self.counts)
        bits = np.zeros(ends[-1] if len(ends) else 0, bool)
        for part, data in answers:
            i, j = np.searchsorted(self.part, [part, part + 1])
            a, b = ends[i] - self.counts[i], ends[j - 1]
            bits[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
        # back from entries to classes: bits of a class lie in a row, beginning at ``begin``
        of_entry = np.empty(len(self.order), np.int64)
        of_entry[self.order] = ends - self.counts
        n = self.count[self.first]
        begin = np.full(len(n), -1)
        begin[self.whole] = of_entry[: len(self.whole)]
        string_bits = bits[of_entry[len(self.whole) :]][self.string] | (self.string_least[self.string] < np.repeat(self.least[self.split], n[self.split]))
        begin[self.split] = len(bits) + np.cumsum(n[self.split]) - n[self.split]
        bits = np.append(bits, string_bits)
        full = self.doc > self.least[self.cls]
        starts = covered(self.at[full], (self.at + self.count)[full], len(self.x))
        some = np.flatnonzero(~full & (begin[self.cls] >= 0))
        k = counted(self.count[some])
        place = np.repeat(self.at[some], self.count[some]) + k
        starts[place[bits[np.repeat(begin[self.cls[some]], self.count[some]) + k]]] = True
        edges = np.flatnonzero(np.diff(starts.view(np.int8), prepend=0, append=0))
        return covered(edges[::2], edges[1::2] + self.length - 1, len(self.x))


def shared(triggers: list[np.ndarray], hot: int) -> list[bytes | None]:
    """For each block's triggers of a part, each once and sorted: bits of those in other blocks, then of hot ones; None if none is."""
    own = [np.unique(x) for x in triggers]
    every, blocks = np.unique(np.concatenate(own), return_counts=True)
    load = np.unique(np.concatenate(triggers), return_counts=True)[1]
    out = []
    for x in own:
        at = np.searchsorted(every, x)
        facts = np.array([blocks[at] > 1, load[at] > hot])
        out.append(np.packbits(facts, axis=1).tobytes() if facts.any() else None)
    return out


def smaller(counts: np.ndarray, docs: np.ndarray, flat: np.ndarray, length: int) -> np.ndarray:
    """Of entries (numbers of strings, documents, bytes in a row): which strings a smaller document has, in order."""
    width, w = 2 * length - TRIGGER, length - TRIGGER + 1
    rows = np.zeros((len(counts), width + 1), np.uint8)
    rows[:, 0] = counts
    rows[:, 1:][np.arange(width) < counts[:, None] + length - 1] = flat
    hashes = np.concatenate([row_hashes(rows[i : i + GATHERED]) for i in range(0, len(rows), GATHERED)])
    cls, first = distinct(hashes, lambda i: rows[i])
    dictionary, n = rows[first], counts[first]
    least = least_of(cls, docs, len(first))
    # suffixes of the dictionary that may occur again
    inside = np.arange(w) < n[:, None]
    hashes = np.concatenate([gram_hashes(dictionary[i : i + GATHERED, 1:], length)[inside[i : i + GATHERED]] for i in range(0, len(dictionary), GATHERED)])
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    again = order[np.append(same, False) | np.append(False, same)]
    phrase, start = np.repeat(np.arange(len(n)), n)[again], counted(n)[again]
    suffixes = np.empty((len(again), length), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(dictionary, length, axis=1)
    for i in range(0, len(again), GATHERED):
        suffixes[i : i + GATHERED] = view[phrase[i : i + GATHERED], start[i : i + GATHERED] + 1]
    found = np.repeat(least, n)
    if len(again):
        suffixes = suffixes.view(f"S{length}").ravel()  # of one width, so bytes of zero at the end do not matter
        array = np.argsort(suffixes, kind="stable")
        at = runs(suffixes[array])
        low = np.minimum.reduceat(least[phrase[array]], at)
        found[again[array]] = np.repeat(low, np.diff(np.append(at, len(array))))
    begin = np.cumsum(n) - n
    return found[np.repeat(begin[cls], counts) + counted(counts)] < np.repeat(docs, counts)


def parted(batches, *columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """(part, its rows) of batches sorted by part, one part at a time."""

    def rows():
        for batch in batches:
            yield from zip(*[batch.column(i).to_pylist() for i in columns], strict=True)

    for part, own in groupby(rows(), key=lambda x: x[0]):
        yield part, list(own)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id (long), n_bytes, spans (start, end) removed and the bytes kept.

    ``kept`` is null for rows that lose nothing, whose text is whole, and
    ``whole_sha256`` is null for the others.
    """
    tasks = 2 * shuffle_partitions(docs.sparkSession)
    parts = PARTS * tasks

    def pack(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32

        def block():
            ids, bodies = zip(*held, strict=True)
            body = b"\0".join([*bodies, b""])
            return pa.RecordBatch.from_pydict(
                {
                    "block": [serial],
                    "ids": [np.array([x or 0 for x in ids], "<i8").tobytes()],
                    "known": [np.array([x is not None for x in ids]).tobytes()],
                    "sizes": [np.array([len(b) for b in bodies], "<i8").tobytes()],
                    "raw": [len(body)],
                    "body": [pa.compress(body, "zstd", asbytes=True)],
                }
            )

        held, size = [], 0
        for batch in batches:
            for x, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = (body.as_py() or "").encode("utf-8", "surrogatepass")
                if held and size + len(body) > BLOCK_BYTES:
                    yield block()
                    held, size, serial = [], 0, serial + 1
                held.append((x, body))
                size += len(body)
        if held:
            yield block()

    def opened(batches) -> Iterator[tuple]:
        """(number, block, answers) of rows that begin as in ``BLOCKS``."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row["ids"], row["known"], row["sizes"], pa.decompress(row["body"], row["raw"], "zstd", asbytes=True), length, parts)
                answers = row.get("answers") or []
                if "answers" in row:
                    block.entries([(a["part"], a["data"]) for a in answers if a["kind"] == KNOWN])
                yield row["block"], block, [(a["part"], a["data"]) for a in answers if a["kind"] == BITS]

    def list_triggers(batches):
        for number, block, _ in opened(batches):
            if rows := list(block.listed()):
                part, values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "block": [number] * len(rows), "triggers": values})

    def meet(batches):
        for part, rows in parted(batches, 0, 1, 2):
            found = shared([np.frombuffer(x, "<u4") for _, _, x in rows], HOT)
            out = [(r[1], data) for r, data in zip(rows, found, strict=True) if data is not None]
            if out:
                yield answered(part, KNOWN, out)

    def answered(part: int, kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        block, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "part": pa.array([part] * len(rows), pa.int32()), "kind": pa.array([kind] * len(rows), pa.int32()), "data": pa.array(data, pa.binary())})

    def send(batches):
        for number, block, _ in opened(batches):
            for part, counts, ids, body in block.sent():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": [number], "counts": [counts], "docs": [ids], "bytes": [body]})

    def compare(batches):
        for part, rows in parted(batches, 0, 1, 2, 3, 4):
            counts = [np.frombuffer(r[2], "u1").astype(np.int64) for r in rows]
            found = smaller(np.concatenate(counts), np.concatenate([np.frombuffer(r[3], "<i8") for r in rows]), np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]), length)
            ends = np.cumsum([n.sum() for n in counts])
            out = [(r[1], np.packbits(found[a:b]).tobytes()) for r, a, b in zip(rows, [0, *ends[:-1]], ends, strict=True) if found[a:b].any()]
            if out:
                yield answered(part, BITS, out)

    def finish(batches):
        for _, block, bits in opened(batches):
            gone = block.removed(bits)
            edges = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0)).reshape(-1, 2)
            of = np.searchsorted(edges[:, 0], [block.begin, block.begin + block.sizes])
            rows = {k: [] for k in ("doc_id", "n_bytes", "spans", "kept", "whole_sha256")}
            held = 0
            for i, (begin, size) in enumerate(zip(block.begin.tolist(), block.sizes.tolist(), strict=True)):
                spans = edges[of[0, i] : of[1, i]] - begin
                own = block.x[begin : begin + size]
                kept = own[~gone[begin : begin + size]].tobytes() if len(spans) else None
                rows["doc_id"].append(int(block.ids[i]) if block.known[i] else None)
                rows["n_bytes"].append(size)
                rows["spans"].append([{"start": a, "end": b} for a, b in spans.tolist()])
                rows["kept"].append(kept)
                rows["whole_sha256"].append(hashlib.sha256(own).hexdigest() if kept is None else None)
                held += len(kept or b"")
                if held >= BATCH_BYTES or i == len(block.ids) - 1:
                    kinds = (pa.int64(), pa.int64(), SPANS, pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), kinds, strict=True)], names=list(rows))
                    rows, held = {k: [] for k in rows}, 0

    def with_answers(answers: DataFrame) -> DataFrame:
        """Blocks beside what they learned; texts travel compressed."""
        own = answers.groupBy("block").agg(F.collect_list(F.struct("part", "kind", "data")).alias("answers"))
        return blocks.join(own, "block", "left")

    def by_part(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "part").sortWithinPartitions("part")

    # written, as places in blocks must stay the same if a task runs again
    blocks = cut(docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), quoted(text).alias("text")).mapInArrow(pack, BLOCKS))
    known = cut(by_part(blocks.mapInArrow(list_triggers, "part int, block bigint, triggers binary")).mapInArrow(meet, ANSWERS))
    sent = with_answers(known).mapInArrow(send, "part int, block bigint, counts binary, docs binary, bytes binary")
    bits = by_part(sent).mapInArrow(compare, ANSWERS)
    return with_answers(known.unionByName(bits)).mapInArrow(finish, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary, whole_sha256 string")
