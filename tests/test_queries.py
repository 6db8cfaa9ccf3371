"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(float(value), 9)) if isinstance(value, (int, float)) else repr(value)


def sorted_rows(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    ours = entry.queries()[name](spark, DATA)
    theirs = duck.sql(entry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted_rows(ours.columns, ours.collect()) == sorted_rows(theirs.columns, theirs.fetchall())


def test_goldens(spark):
    got = entry.queries()["best_split_d1"](spark, DATA).orderBy("node_id").collect()
    assert [(r.feature_id, r.threshold_id, r.n_left, r.n_right) for r in got] == [(24, 3, 18, 482), (45, 5, 10, 8), (55, 5, 398, 84)]
    assert -got[0].gain * 500.00001 / 500 == pytest.approx(3.272277895, abs=1e-6)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
