"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import SCHEMA, corpus, frame, hard
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.llm import lsm, prefixfree, simhash
from arborlake.llm.graph import connected_components


def groups_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[(r[1] or "").encode().lower()].append(r[0])
    return found


@pytest.mark.parametrize("width", [32, 1])  # one byte: digests collide and bytes must decide
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_copies(spark, width, keep):
    rows = corpus()
    got = {r.doc_id: r for r in lsm.mark_duplicates(frame(spark, rows), keep=keep, digest_bytes=width).collect()}
    assert len(got) == len(rows)
    for body, ids in groups_of(rows).items():
        best = min(ids) if keep == "smallest" else max(ids)
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(ids), i == best, hashlib.sha256(body).hexdigest())


def test_many_memtables(spark, monkeypatch):
    monkeypatch.setattr(lsm, "MEMTABLE_ROWS", 3)
    rows = corpus(2)
    got = {r.doc_id: r.keep_id for r in lsm.mark_duplicates(frame(spark, rows), keep="largest").collect()}
    assert got == {i: max(ids) for ids in groups_of(rows).values() for i in ids}


def test_runs_merge():
    rng = np.random.default_rng(1)
    keys = [np.unique(rng.integers(0, 300, 60)) for _ in range(7)]
    runs = [lsm.Run(np.array([b"%032d" % k for k in own], "S32"), np.ones(len(own), np.int64)) for own in keys]
    merged = lsm.compact(runs)
    all_keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    assert [int(x) for x in merged.digests] == all_keys.tolist() and merged.counts.tolist() == counts.tolist()


def test_exact_hard_cases(spark):
    got = lsm.mark_duplicates(hard(spark), keep="largest").collect()
    assert len(got) == 24
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)} for rows in by.values())
    assert lsm.mark_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = lsm.drop_duplicates(hard(spark), keep="largest")
    assert kept.columns == hard(spark).columns and kept.select("text").distinct().count() >= 10


def fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> j & 1 for s in shingles) for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(shingles))


def components(values, radius, group=None, second=None):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (group is None or group[i] == group[j]) and (second is None or second[i] != second[j]) and (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_copies(spark):
    rows = corpus(3)
    got = {r.doc_id: r for r in simhash.components(frame(spark, rows), radius=8).collect()}
    prints = [fingerprint(r[1]) for r in rows]
    assert [got[r[0]].simhash % (1 << 64) for r in rows] == prints
    assert [got[r[0]].component_id for r in rows] == [rows[i][0] for i in components(prints, 8)]


def test_near_hard_cases(spark):
    got = simhash.components(hard(spark)).collect()
    assert len(got) == 24 and {r.component_id for r in got if r.simhash == 0} == {9}
    assert simhash.components(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.keep_one(frame(spark, corpus(3)))
    assert kept.columns == frame(spark, corpus(3)).columns
    assert kept.count() == len(set(components([fingerprint(r[1]) for r in corpus(3)], 4)))


def test_chunks_of_a_long_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = np.random.default_rng(4)
    values = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64) ^ np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64), rng.integers(0, 1 << 62, 40).astype(np.uint64)]))
    prints = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp bigint")
    found = {r.node: r.root for r in connected_components(simhash.links(prints, 4)).collect()}
    want = components([int(x) for x in values], 4)
    signed = values.view(np.int64).tolist()
    by = defaultdict(list)
    for v, c in zip(signed, want, strict=True):
        by[c].append(v)
    assert found == {v: min(own) for own in by.values() if len(own) > 1 for v in own}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 255), st.booleans()), min_size=1, max_size=150), st.integers(0, 5), st.booleans())
def test_bit_sliced_links(rows, radius, split):
    rows = sorted(rows, key=lambda r: r[0])
    group = np.array([r[0] for r in rows])
    values = np.array([r[1] * 0x0101010000000001 % (1 << 64) for r in rows], np.uint64)
    second = np.array([r[2] and split for r in rows])
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    mixed = {g for g in group.tolist() if second[group == g].any()}
    edges = simhash.linked(values, starts, second, radius)
    for g in set(group.tolist()):
        own = np.flatnonzero(group == g)
        want = components([int(values[i]) for i in own], radius, None, [bool(second[i]) for i in own] if g in mixed else None)
        root = {int(i): int(i) for i in own}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a in root:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        assert [find(int(i)) for i in own] == [int(own[k]) for k in want]


@pytest.mark.parametrize("n", [10, 1 << 14, 1 << 20, 1 << 30])
def test_bands_are_exact(n):
    b = simhash.bands(n, 4)
    assert 5 <= b <= 8 and (n < 1 << 14 or 64 * (b - 4) / b >= np.log2(n) or b == 8)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def removed(rows, length):
    seen, out = {}, {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], i) < i:
                cover[p : p + length] = b"\1" * length
        out[i] = cover
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages(spark, seed):
    rows = corpus(seed)
    want = removed(rows, 50)
    got = {r.doc_id: r for r in prefixfree.remove_repeats(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        b, r = (text or "").encode(), got[i]
        cover = bytearray(len(b))
        for span in r.spans:
            cover[span.start : span.end] = b"\1" * (span.end - span.start)
        assert cover == want[i] and r.n_bytes == len(b)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        assert (bytes(r.kept) == kept) if r.kept is not None else (r.whole_sha256 == hashlib.sha256(kept).hexdigest())


def test_passages_hard_cases(spark):
    passage = "a passage of more than fifty bytes that several of these texts share with each other "
    rows = [(1, "A" * 49), (2, passage), (None, passage), (3, "zz" + passage), (3, passage * 2), (4, None), (5, "")]
    found = prefixfree.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    got = sorted((r.doc_id or 0, r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in found.collect())
    n = len(passage)
    assert got == sorted([(1, 49, 0), (2, n, 0), (0, n, 0), (3, n + 2, n), (3, 2 * n, 2 * n), (4, 0, 0), (5, 0, 0)])
    assert prefixfree.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixfree.remove_repeats(hard(spark)).count() == 24


def blocks_of(texts, parts=3, size=4):
    """Blocks of some texts each, with ids in order."""
    for i in range(0, len(texts), size):
        own = texts[i : i + size]
        ids, sizes = np.arange(i, i + len(own), dtype="<i8"), np.array([len(b) for b in own], "<i8")
        yield prefixfree.Block(ids.tobytes(), np.ones(len(own), bool).tobytes(), sizes.tobytes(), b"\0".join([*own, b""]), 50, parts)


def locally(texts, hot, parts=3):
    """Removed bytes of each text by the operator's steps without Spark."""
    blocks = list(blocks_of(texts, parts))
    listed = [dict(b.listed()) for b in blocks]
    learned = [[] for _ in blocks]
    for part in range(parts):
        has = [i for i, x in enumerate(listed) if part in x]
        found = prefixfree.shared([np.frombuffer(listed[i][part], "<u4") for i in has], hot) if has else []
        for i, data in zip(has, found, strict=True):
            if data is not None:
                learned[i].append((part, data))
    sent = []
    for block, known in zip(blocks, learned, strict=True):
        block.entries(known)
        sent.append({x[0]: x[1:] for x in block.sent()})
    bits = [[] for _ in blocks]
    for part in range(parts):
        for_part = [(i, x[part]) for i, x in enumerate(sent) if part in x]
        if for_part:
            columns = [[np.frombuffer(x[k], kind) for _, x in for_part] for k, kind in enumerate(("u1", "<i8", "u1"))]
            counts = [c.astype(np.int64) for c in columns[0]]
            found = prefixfree.smaller(np.concatenate(counts), np.concatenate(columns[1]), np.concatenate(columns[2]), 50)
            ends = np.cumsum([n.sum() for n in counts])
            for (i, _), a, b in zip(for_part, [0, *ends[:-1]], ends, strict=True):
                bits[i].append((part, np.packbits(found[a:b]).tobytes()))
    out = []
    for block, own in zip(blocks, bits, strict=True):
        gone = block.removed(own)
        out += [bytes(gone[a : a + n].view(np.uint8)) for a, n in zip(block.begin, block.sizes, strict=True)]
    return out


def passages(seed, n=24):
    """Texts of few letters with copies, repeats of a byte, zeros and a common line in other surroundings."""
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 100, rng.integers(0, 400), np.uint8)) for _ in range(n)]
    line = bytes(rng.integers(97, 123, 70, np.uint8))
    for i in range(0, n, 2):
        at = rng.integers(0, len(texts[i]) + 1)
        texts[i] = texts[i][:at] + line + texts[i][at:]
    texts[5], texts[7], texts[9], texts[11] = texts[4], texts[4][10:], b"\0" * 200, b"a" * 300
    texts[13], texts[15], texts[17] = b"\0" * 120, b"a" * 90 + texts[2], b"ab" * 90
    return texts


def covered(texts):
    seen, out = {}, []
    for i, b in enumerate(texts):
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                cover[p : p + 50] = b"\1" * 50
        out.append(bytes(cover))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [1 << 30, 3, 0])
def test_steps_against_brute_force(seed, hot):
    """Phrases compared whole, or cut into their strings."""
    texts = passages(seed)
    assert locally(texts, hot) == covered(texts)


@pytest.mark.parametrize("hot", [1 << 30, 0])
def test_hashes_only_choose(monkeypatch, hot):
    """Where all hashes collide, bytes still decide."""
    monkeypatch.setattr(prefixfree, "row_hashes", lambda rows: np.full(len(rows), 7, np.uint64))
    hashes = prefixfree.gram_hashes
    monkeypatch.setattr(prefixfree, "gram_hashes", lambda x, k: hashes(x, k) & np.uint64(0x300000003))
    texts = passages(9)
    assert locally(texts, hot) == covered(texts)


def test_long_texts_are_parsed_in_pieces(monkeypatch):
    body = np.random.default_rng(2).integers(97, 100, 5000, np.uint8)
    body[1000:2000] = 97
    cut = np.array([0, 700, 760, 3000]), np.array([699, 59, 2000, 2000])
    whole = prefixfree.parse(body, *cut, 50)
    monkeypatch.setattr(prefixfree, "PIECE", 313)
    assert all((a == b).all() for a, b in zip(whole, prefixfree.parse(body, *cut, 50), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.integers(1, 255))
def test_every_string_starts_in_one_phrase(body, letters):
    x = np.frombuffer(bytes(b % letters for b in body), np.uint8)
    at, count, triggers = prefixfree.parse(x, np.array([0]), np.array([len(x)]), 50)
    starts = [p for a, n in zip(at, count, strict=True) for p in range(a, a + n)]
    assert starts == list(range(len(x) - 49)) and (len(count) == 0 or 1 <= count.min() <= count.max() <= 31)
    of = {}
    for p, t in zip(starts, np.repeat(triggers, count), strict=True):
        assert of.setdefault(x[p : p + 50].tobytes(), t) == t
