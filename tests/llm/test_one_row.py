"""Both dedup stages keep one row of each group, whatever the ids."""

from collections import Counter

import pytest
from helpers import SCHEMA, corpus, frame, hard
from test_dedup import components, fingerprint

from arborlake.llm import lsm, simhash


def plain(text):
    return (text or "").encode().lower()


def doubled():
    """A table ingested twice, one id with two texts, and texts that only rows without an id have."""
    rows = corpus(3) * 2
    rows += [(6, "another text of the sixth one", None, "c", 1), (6, rows[0][1], None, "c", 1)]
    lonely = " ".join(f"lonely{i}" for i in range(30))
    return rows + [(None, lonely, None, None, 2), (None, lonely.upper(), None, None, 2), (None, rows[7][1], None, None, 3), (None, None, None, None, 4)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_keeps_one_row(spark, keep):
    rows, best = doubled(), min if keep == "smallest" else max
    kept = lsm.drop_duplicates(frame(spark, rows), keep=keep).collect()
    assert max(Counter(plain(r.text) for r in kept).values()) == 1
    want = {t: [r[0] for r in rows if plain(r[1]) == t and r[0] is not None] for t in {plain(r[1]) for r in rows}}
    assert {plain(r.text): r.doc_id for r in kept} == {t: best(ids) if ids else None for t, ids in want.items()}
    assert set(map(tuple, kept)) <= set(rows)


def test_near_keeps_one_row(spark):
    rows = doubled()
    kept = simhash.keep_one(frame(spark, rows)).collect()
    prints = [fingerprint(r[1]) for r in rows]
    groups = {}
    for root, r in zip(components(prints, 4), rows, strict=True):
        groups.setdefault(root, []).append(r[0])
    least = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert sorted((r.doc_id for r in kept), key=str) == sorted(least, key=str)
    assert len({root for root, r in zip(components([fingerprint(r.text) for r in kept], 4), kept, strict=True)}) == len(groups)
    assert set(map(tuple, kept)) <= set(rows)


def test_columns_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for stage in (lsm.drop_duplicates, simhash.keep_one):
        assert stage(empty).count() == 0 and stage(hard(spark)).columns == hard(spark).columns
    kept = lsm.drop_duplicates(hard(spark), keep="largest").collect()
    assert len(kept) == len({plain(r.text) for r in hard(spark).collect()})
