"""Offsets of records under keys that are null or repeat."""

import hashlib
import random

import pytest

from arborlake.llm import warc


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("seed", range(2))
def test_offsets_against_brute_force(spark, monkeypatch, seed, digits):
    """A third of the rows under a null key and a third under one key, many of them equal."""
    monkeypatch.setattr(warc, "PART_DIGITS", digits)
    monkeypatch.setattr(warc, "FILE_KEYS", 10)
    rng = random.Random(seed)
    key = lambda: rng.choice([None, 7, rng.randint(-15, 40)])
    rows = [(key(), rng.choice(["u", None]), "é" * rng.choice([0, 1, 1, 1, rng.randint(0, 99)])) for _ in range(600)]
    found = []
    for k, url, html in rows:
        body = html.encode()
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if k is None else k}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        data = head + body + b"\r\n\r\n"
        found.append((-1 if k is None else k // 10, k, hashlib.sha256(data).hexdigest(), len(data)))
    want, ends = [], {}
    # a null key and keys -10..-1 share file -1, where the null key is in front
    for file, k, sha, length in sorted(found, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        want.append((file, k, ends.get(file, 0), length, sha))
        ends[file] = ends.get(file, 0) + length
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = warc.manifest(pages)
    assert got.columns == ["file", "key", "offset", "length", "sha256"]
    order = lambda r: (r[0], r[2])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert {r.status for r in warc.audit(got, warc.manifest(pages.repartition(5))).select("status").distinct().collect()} == {"ok"}
