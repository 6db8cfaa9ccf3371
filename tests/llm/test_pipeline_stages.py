"""Each stage of the pipeline on hard tables."""

from collections import Counter

import pytest
from helpers import SCHEMA, corpus, frame, hard
from test_dedup import components, fingerprint
from test_text import tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(autouse=True)
def with_tokenizer():
    tokenizer()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    docs = spark.createDataFrame([], SCHEMA)
    out = stage(spark, docs, "")
    assert out.count() == 0 and (name == "bpe_encode" or out.columns == docs.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_hard_table(spark, name, stage):
    """Null ids, repeated rows, clashing names and a long text."""
    rows = hard(spark)
    docs = rows.unionByName(rows.limit(1).selectExpr("1000 AS doc_id", "repeat('Long words ', 200000) AS text", *[f"`{c}`" for c in rows.columns[2:]]))
    all_rows = docs.collect()
    out = stage(spark, docs, "").collect()
    if name == "bpe_encode":
        assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in all_rows)
        return
    assert set(map(tuple, out)) <= set(map(tuple, all_rows)) and out[0].asDict().keys() == all_rows[0].asDict().keys()
    if name == "language_id":
        assert Counter(map(tuple, out)) == Counter(tuple(r) for r in all_rows if any(c.isalpha() for c in r.text or ""))
    if name == "exact_dedup":
        assert Counter((r.text or "").encode().lower() for r in out) == Counter({(r.text or "").encode().lower() for r in all_rows})
    if name == "near_dedup":
        assert len(out) == len(set(components([fingerprint(r.text) for r in all_rows], 4)))


def test_stages_one_after_the_other(spark, tmp_path):
    """All stages together give what the stages give, written and read between them."""
    frame(spark, corpus(4, 60)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == rows(docs)
