"""The thin queries on whole small tables against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from helpers import corpus, frame
from pyspark.sql import functions as F
from test_dedup import components, fingerprint, removed
from test_text import base_rules, naive_bayes, tokenizer

from arborlake.llm import catalog, idfilter, toxicity

ROWS = corpus(11, 90)
TEXT = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    frame(spark, ROWS).write.parquet(str(path / "documents.parquet"))
    labels = [(r[0], int(i % 4 > 0), int("changed" in (r[1] or ""))) for i, r in enumerate(ROWS)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(i, f"u{i}", "html") for i in range(200)], "page_id bigint, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path)


def run(spark, tables, name):
    out = catalog.queries()[name](spark, tables)
    return dict(out.dtypes), out.collect()


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1(spark, tables):
    kinds, got = run(spark, tables, "op1_quality")
    assert all(kinds[c] == "bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) and kinds["kept"] == kinds["base_failed"] == "boolean"
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(TEXT[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_op5_and_op9(spark, tables):
    for name in ("op5_language_id", "op9_toxicity"):
        kinds, got = run(spark, tables, name)
        assert {r.doc_id: r.held_out for r in got} == {i: held(i) for i in TEXT} and len(got) == len(ROWS)
        assert kinds["score"] == "double" and all(0 <= r.score <= 1 for r in got)
        if name == "op9_toxicity":
            assert kinds["predicted"] == "int" and all(r.predicted == int(r.score >= 0.3) for r in got)
        else:
            assert {r.lang_pred for r in got} <= {"en", "de", "und"}
            assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in TEXT[r.doc_id] or "")) for r in got)


def test_op5_against_brute_force(spark, tables):
    _, got = run(spark, tables, "op5_language_id")
    want = dict(zip(TEXT, naive_bayes([(r[1], r[2], not held(r[0])) for r in ROWS]), strict=True))
    for r in got:
        name, p = want[r.doc_id]
        assert r.score == pytest.approx(p, abs=1e-9) and (r.lang_pred == name or abs(p - 0.5) < 1e-9)


def test_op9_against_brute_force(spark, tables):
    """The same lexicons, folds and calibration, counted one text after the other on the driver."""
    _, got = run(spark, tables, "op9_toxicity")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    rows = spark.createDataFrame([(i,) for i in sorted(labels) if not held(i)], "i bigint").selectExpr("i", "pmod(xxhash64(i, 'fold'), 4) AS fold").collect()

    def lexicon(without):
        own = [r.i for r in rows if r.fold != without]
        keys = {i: {k for w in (TEXT[i] or "").split() if toxicity.plain(w) for k in toxicity.keys_of(toxicity.plain(w))} for i in own}
        base, out = min(max(sum(labels[i] for i in own) / len(own), 1e-6), 1 - 1e-6), {}
        for k in set().union(*keys.values()):
            t, n = sum(labels[i] for i in own if k in keys[i]), sum(k in keys[i] for i in own)
            if t:
                e = t * math.log(t / n / base) + ((n - t) * math.log((1 - t / n) / (1 - base)) if n > t else 0.0)
                if e >= toxicity.EVIDENCE and t / n >= min(0.5, 4 * base):
                    out[k] = e
        return out

    words = [lexicon(k) for k in (0, 1, 2, 3, None)]
    x = np.array([[toxicity.describe(TEXT[r.i], toxicity.Lookup(w)) for w in words] for r in rows])
    trees, calibration = toxicity.fitted(x, np.array([labels[r.i] for r in rows], float), np.array([r.fold for r in rows]))
    assert words[-1] and len(got) == len(ROWS)
    for r in got:
        want = calibration.predict(trees.margin(np.array([toxicity.describe(TEXT[r.doc_id], toxicity.Lookup(words[-1]))])))[0]
        assert r.score == pytest.approx(want, abs=1e-9)


def test_op6(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    kinds, got = run(spark, tables, "op6_bpe")
    assert len(got) == len(ROWS) and kinds["n_tokens"] == "bigint"
    for r in got:
        ids = library.encode(TEXT[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op7(spark, tables):
    _, got = run(spark, tables, "op7_simhash")
    prints = [fingerprint(r[1]) for r in ROWS]
    want = {r[0]: (f"{p:016x}", ROWS[c][0]) for r, p, c in zip(ROWS, prints, components(prints, 4), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(ROWS)


def test_op10(spark, tables):
    kinds, got = run(spark, tables, "op10_repeated_passages")
    want = removed(ROWS, 50)
    assert len(got) == len(ROWS) and all(kinds[c] == "bigint" for c in ("n_bytes", "n_removed", "n_spans"))
    for r in got:
        body, cover = (TEXT[r.doc_id] or "").encode(), want[r.doc_id]
        kept = bytes(x for x, c in zip(body, cover, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(body), sum(cover), spans, hashlib.sha256(kept).hexdigest())


def test_queries_with_sql(spark, tables):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    for name, sql in catalog.oracle_sql().items():
        kinds, got = run(spark, tables, name)
        theirs = con.sql(sql)
        at = [theirs.columns.index(c) for c in kinds]
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r[i] for i in at) for r in theirs.fetchall()))), name


def test_op3_covers_every_document(spark, tables):
    _, got = run(spark, tables, "op3_license_scan")
    assert sorted(r.doc_id for r in got) == sorted(TEXT)


def test_id_filter(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    words = idfilter.build(ids, "doc_id")
    hashes = np.array([r.h for r in spark.range(3000).select(idfilter.id_hash(F.col("id")).alias("h")).collect()])
    got = idfilter.admits(words, hashes)
    assert got[::3].all() and got.mean() < 0.4
