"""Queries answer all rows of tables of any size, not those below a fixed id."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from arborlake.operators.histograms import node_of_position


def test_node_range_join_has_every_order(spark, tmp_path):
    keys = [*range(0, 40_000, 7), 15_999, 16_000, 1_234_567, -1, -1000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.node_id: (r.n, r.first_pos, r.last_pos) for r in entry.queries()["node_range_join"](spark, str(tmp_path)).collect()}
    nodes = Counter(k // 1000 for k in keys)
    assert got == {k: (n, min(x for x in keys if x // 1000 == k), max(x for x in keys if x // 1000 == k)) for k, n in nodes.items()}


def test_node_range_join_of_no_orders(spark, tmp_path):
    spark.createDataFrame([], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    assert entry.queries()["node_range_join"](spark, str(tmp_path)).count() == 0


def test_range_join_against_brute_force(spark):
    ranges = [(0, -50, -3), (1, -2, 4), (2, 5, 5), (3, 9, 8), (4, 10, 5000), (5, 4990, 5003), (6, 2**60, 2**60 + 7)]
    positions = [*range(-60, 60), *range(4980, 5010), 2**60 - 1, 2**60 + 7, 2**60 + 8, None, 5, 5]
    got = node_of_position(spark.createDataFrame([(p,) for p in positions], "pos bigint"), spark.createDataFrame(ranges, "node_id bigint, idx_begin bigint, idx_end bigint"))
    assert Counter(map(tuple, got.collect())) == Counter((p, k) for p in positions if p is not None for k, a, b in ranges if a <= p <= b)


def test_tile_samples_repeats_every_sample(spark, tmp_path):
    n = 1500
    spark.range(n).selectExpr("id AS vec_id", "int(id % 10) AS label", "array(0f) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = entry.queries()["tile_samples"](spark, str(tmp_path)).collect()
    assert sorted(r.sample_id for r in rows) == list(range(2 * n + 234)) and all(r.label == r.sample_id % n % 10 for r in rows)


@pytest.mark.parametrize("n", [1, 100, 501, 1234])
def test_tile_samples_agrees_with_sql_where_that_uses_every_sample(spark, tmp_path, n):
    spark.range(n).selectExpr("id AS vec_id", "int(id % 10) AS label", "array(0f) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["tile_samples"](spark, str(tmp_path)).select("sample_id", "label").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    sql = entry.oracle_sql()["tile_samples"]
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT sample_id, label FROM ({sql})").fetchall())


def test_tile_samples_uses_every_sample_above_the_size_in_the_sql(spark, tmp_path):
    spark.range(1235).selectExpr("id AS vec_id", "int(id % 10) AS label", "array(0f) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = entry.queries()["tile_samples"](spark, str(tmp_path)).collect()
    assert {r.sample_id % 1235 for r in rows} == set(range(1235))
