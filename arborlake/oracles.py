"""The queries as SQL for DuckDB, written from the formulas and not from the Spark plans."""

from __future__ import annotations

T = 8


def text(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + then


SAMPLES = "samples AS (SELECT vec_id AS sample_id, label, embedding AS features FROM embeddings)"
LONG = "long AS (SELECT sample_id, label, unnest(range(len(features)))::INT AS feature_id, unnest(features)::FLOAT AS value FROM samples)"
META = "meta AS (SELECT feature_id, 1024::FLOAT AS max_proxy, min(value) AS fmin, max(value) AS fmax FROM long GROUP BY feature_id)"
EPS = "1e-5::FLOAT"
CANDS = f"""cands AS (
  SELECT feature_id, i::INT AS threshold_id,
         CASE WHEN i = 0 THEN (floor(max_proxy / 2 - 1)::FLOAT - {EPS})::FLOAT
              WHEN i = 1 THEN (0::FLOAT - {EPS})::FLOAT
              WHEN i = 2 THEN (fmin - {EPS})::FLOAT
              ELSE ((fmin - {EPS})::FLOAT + ((i - 2)::FLOAT * (((fmax - fmin)::FLOAT / {T - 3}::FLOAT)::FLOAT))::FLOAT)::FLOAT END AS threshold
  FROM meta, range({T}) AS r(i))"""
ROOT = "n0 AS (SELECT *, 0::BIGINT AS node_id FROM samples)"
BASE = (SAMPLES, LONG, META, CANDS)


def level(d: int) -> list[str]:
    """Splits of level ``d`` from n{d}, the samples with their node, and the next level's samples."""
    entropy = "0.0::DOUBLE" if d == 0 else f"CASE WHEN b.node_id % 2 = 1 THEN p.left_entropy ELSE p.right_entropy END"
    parent = "" if d == 0 else f"LEFT JOIN best{d - 1} p ON p.node_id = (b.node_id - 1) // 2"
    return [*scores(d, "1::BIGINT"), f"""gain{d} AS (
  SELECT b.node_id, b.feature_id, b.threshold_id, b.il AS left_entropy, b.ir AS right_entropy, b.n_left, b.n_right,
         {entropy} - (b.sl * b.il + b.sr * b.ir) / (b.sl + b.sr + 1e-5::DOUBLE) AS gain
  FROM score{d} b {parent})""", f"""best{d} AS (
  SELECT g.*, c.threshold FROM gain{d} g JOIN cands c USING (feature_id, threshold_id)
  QUALIFY row_number() OVER (PARTITION BY g.node_id ORDER BY round(g.gain, 9) DESC, g.feature_id, g.threshold_id) = 1)""", f"""n{d + 1} AS (
  SELECT s.sample_id, s.label, s.features, 2 * s.node_id + 1 + (s.features[b.feature_id + 1]::FLOAT > b.threshold)::BIGINT AS node_id
  FROM n{d} s JOIN best{d} b USING (node_id))"""]


def scores(d: int, weight: str, measure: str = "shannon") -> list[str]:
    """Histograms and both children's impurity for every candidate of level ``d``."""
    impurity = lambda s: (f"CASE WHEN sum({s}) > 0 THEN log2(sum({s})) - sum({s} * log2({s} + 1e-5::DOUBLE)) / sum({s}) ELSE 0 END" if measure == "shannon" else f"CASE WHEN sum({s}) > 0 THEN 1 - sum({s} * {s}) / (sum({s}) * sum({s})) ELSE 0 END")
    return [f"parent{d} AS (SELECT node_id, label, count(*) AS n FROM n{d} GROUP BY ALL)", f"w{d} AS (SELECT label, {weight} AS w FROM samples GROUP BY label)", f"""child{d} AS (
  SELECT s.node_id, c.feature_id, c.threshold_id, s.label, sum((l.value > c.threshold)::BIGINT)::BIGINT AS n_right
  FROM n{d} s JOIN long l USING (sample_id) JOIN cands c ON c.feature_id = l.feature_id GROUP BY ALL)""", f"""both{d} AS (
  SELECT c.node_id, feature_id, threshold_id, c.label, p.n - n_right AS n_left, n_right
  FROM child{d} c JOIN parent{d} p ON p.node_id = c.node_id AND p.label = c.label)""", f"""score{d} AS (
  SELECT node_id, feature_id, threshold_id, sum(l) AS sl, sum(r) AS sr, {impurity('l')} AS il, {impurity('r')} AS ir, sum(n_left)::BIGINT AS n_left, sum(n_right)::BIGINT AS n_right
  FROM (SELECT b.*, n_left::DOUBLE / w AS l, n_right::DOUBLE / w AS r FROM both{d} b JOIN w{d} USING (label) WHERE w > 0) GROUP BY ALL)"""]


ROOT_SCORES = "node_id, feature_id, threshold_id, round(-(sl * il + sr * ir) / (sl + sr + 1e-5::DOUBLE), 9) AS gain, round(il, 9) AS left_entropy, round(ir, 9) AS right_entropy, n_left, n_right"
TREE = (*BASE, ROOT, *level(0), *level(1))
PREDICTED = """leaf AS (
  SELECT node_id, label AS prediction, n AS max_val FROM (SELECT node_id, label, count(*) AS n FROM n2 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, label) = 1)""", "pred AS (SELECT sample_id, label, prediction FROM n2 JOIN leaf USING (node_id))"
HISTS = "hists AS (SELECT node_id, label, count(*) AS n FROM (SELECT node_id, label FROM n0 UNION ALL SELECT node_id, label FROM n1 UNION ALL SELECT node_id, label FROM n2) GROUP BY ALL)"
ALL_NODES = "SELECT node_id, feature_id, threshold_id, threshold, round(gain, 9) AS gain, n_left, n_right FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1)"
BEST = " FROM score0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY gain DESC, feature_id, threshold_id) = 1"
PIXELS = """frames AS (SELECT f::INT AS frame_id, r::INT AS row, c::INT AS col, r BETWEEN 4 AND 27 AND c BETWEEN 4 AND 27 AS inside FROM range(4) a(f), range(32) b(r), range(32) d(c))""", """pixels AS (
  SELECT frame_id, row, col, CASE WHEN inside THEN 450 + row * 4 + col * 2 + frame_id * 7 ELSE 0 END::FLOAT AS z,
         CASE WHEN inside THEN (row // 4 + col // 5 + frame_id) % 7 + 1 ELSE 0 END::INT AS lbl FROM frames)"""
LINE_BASE = (
    "samples AS (SELECT row_number() OVER () AS sample_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, [l_quantity::FLOAT, l_extendedprice::FLOAT, l_discount::FLOAT, l_tax::FLOAT] AS features FROM lineitem)",
    LONG,
    META,
    CANDS,
)

SQL = {
    "scan_features": text(SAMPLES, LONG, then="SELECT sample_id, feature_id, value FROM long WHERE feature_id < 4"),
    "scan_labels": "SELECT vec_id AS sample_id, label FROM embeddings",
    "num_classes": "SELECT max(label) + 1 AS num_classes FROM embeddings",
    "label_stats": "SELECT count(quality) AS num_samples, max(quality) + 1 AS num_classes FROM labels",
    "inspect_dataset": "SELECT count(*) AS num_samples, max(len(embedding)) AS num_features, max(label) + 1 AS num_classes FROM embeddings",
    "label_hist": "SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic",
    "row_prefix": "SELECT vec_id AS sample_id, label FROM embeddings WHERE vec_id < 100",
    "valid_minmax": """WITH v AS (SELECT 0 AS feature_id, o_totalprice::FLOAT AS x FROM orders UNION ALL SELECT 1, (o_orderkey % 7)::FLOAT FROM orders UNION ALL SELECT 2, 6::FLOAT FROM orders)
SELECT feature_id, 6::FLOAT AS max_proxy, coalesce(min(x) FILTER (abs(x) <> 6), -6)::FLOAT AS fmin, coalesce(max(x) FILTER (abs(x) <> 6), 6)::FLOAT AS fmax FROM v GROUP BY feature_id""",
    "thresh_meta": text(SAMPLES, LONG, META, then="SELECT * FROM meta"),
    "candidates": text(*BASE, then="SELECT * FROM cands"),
    "split_predicate": "SELECT o_orderstatus, o_totalprice::FLOAT > 150000.5::FLOAT AS goes_right, count(*) AS n FROM orders GROUP BY ALL",
    "align_features": "SELECT vec_id AS sample_id, label, embedding[4]::FLOAT AS f3 FROM embeddings",
    "node_range_join": "SELECT o_orderkey // 1000 AS node_id, count(*) AS n, min(o_orderkey) AS first_pos, max(o_orderkey) AS last_pos FROM orders WHERE o_orderkey BETWEEN 0 AND 15999 GROUP BY 1",
    "whole_blocks": "SELECT o_orderkey, ((o_orderkey + 6) // 7)::BIGINT AS blocks, o_orderkey // 7 * 7 AS snapped FROM orders",
    "tile_samples": "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT i AS sample_id, label FROM n, range(1234) r(i) JOIN embeddings ON vec_id = i % (SELECT n FROM n)",
    "repeat_features": "SELECT vec_id AS sample_id, i::INT AS feature_id, embedding[i % 5 + 1]::FLOAT AS value FROM embeddings, range(12) r(i)",
    "repeat_meta": text(SAMPLES, LONG, META, then="SELECT i::INT AS feature_id, max_proxy, fmin, fmax FROM range(150) r(i) JOIN meta ON feature_id = i % (SELECT count(*) FROM meta)"),
    "cast_features": "SELECT o_orderkey AS sample_id, 0 AS feature_id, (o_orderkey % 100)::FLOAT AS value FROM orders UNION ALL SELECT o_orderkey, 1, (o_custkey % 100)::FLOAT FROM orders",
    "weights_apriori": "SELECT label, count(*) AS w FROM embeddings GROUP BY label",
    "weights_file": "SELECT i::INT AS label, CASE i WHEN 0 THEN 3 WHEN 2 THEN 5 ELSE 1 END::BIGINT AS w FROM range(10) r(i)",
    "parent_hist_d0": "SELECT 0::BIGINT AS node_id, label, count(*) AS n FROM embeddings GROUP BY label",
    "child_hist_d0": text(*BASE, ROOT, *scores(0, "1::BIGINT"), then="SELECT * FROM child0"),
    "left_hist": text(*BASE, ROOT, *scores(0, "1::BIGINT"), then="SELECT * FROM both0"),
    "weighted_entropy": """WITH h AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT n::DOUBLE / CASE WHEN label % 2 = 0 THEN n ELSE 2 END AS p FROM h)
SELECT 0::BIGINT AS node_id, round(sum(p), 9) AS total, round(log2(sum(p)) - sum(p * log2(p + 1e-5::DOUBLE)) / sum(p), 9) AS entropy FROM p""",
    "gini_scores": text(*BASE, ROOT, *scores(0, "1::BIGINT", "gini"), then=f"SELECT {ROOT_SCORES} FROM score0"),
    "weighted_gini": text(*BASE, ROOT, *scores(0, "(CASE WHEN label % 3 = 0 THEN 0 ELSE label + 1 END)::BIGINT", "gini"), then=f"SELECT {ROOT_SCORES} FROM score0"),
    "split_scores_d0": text(*BASE, ROOT, *scores(0, "1::BIGINT"), then=f"SELECT {ROOT_SCORES} FROM score0"),
    "best_split_d0": text(*BASE, ROOT, *scores(0, "1::BIGINT"), then=f"SELECT {ROOT_SCORES}{BEST}"),
    "best_split_apriori": text(*BASE, ROOT, *scores(0, "count(*)"), then=f"SELECT {ROOT_SCORES}{BEST}"),
    "best_split_lineitem": text(*LINE_BASE, ROOT, *scores(0, "1::BIGINT"), then=f"SELECT {ROOT_SCORES}{BEST}"),
    "route_d0": text(*BASE, ROOT, *level(0), then="SELECT sample_id, node_id FROM n1"),
    "parent_hist_d1": text(*BASE, ROOT, *level(0), then="SELECT node_id, label, count(*) AS n FROM n1 GROUP BY ALL"),
    "best_split_d1": text(*TREE, then=ALL_NODES),
    "leaf_assignment": text(*TREE, then="SELECT sample_id, node_id, 2 AS depth FROM n2"),
    "tree_hists_d1": text(*TREE, HISTS, then="SELECT * FROM hists"),
    "leaf_labels": text(*TREE, HISTS, then="SELECT node_id, label, n AS max_val FROM hists QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, label) = 1"),
    "byte_hist": text(*TREE, HISTS, then="SELECT node_id, label, n, (n * 255 // max(n) OVER (PARTITION BY node_id))::SMALLINT AS n_byte FROM hists"),
    "predict_d1": text(*TREE, *PREDICTED, then="SELECT sample_id, prediction FROM pred"),
    "accuracy": text(*TREE, *PREDICTED, then="SELECT count(*) AS n, sum((label = prediction)::BIGINT)::BIGINT AS correct, round(100.0::DOUBLE * sum((label = prediction)::BIGINT) / count(*), 9) AS accuracy FROM pred"),
    "per_class_accuracy": text(*TREE, *PREDICTED, then="""SELECT i::INT AS label, count(label) AS n, round(100.0::DOUBLE * count(label) / (SELECT count(*) FROM pred), 9) AS share,
       CASE WHEN count(label) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (label = prediction) / count(label), 9) END AS accuracy
FROM range(12) r(i) LEFT JOIN pred ON label = i GROUP BY i"""),
    "tree_progress": text(*TREE, HISTS, "nodes AS (SELECT node_id, sum(n) AS n, max(n) AS top FROM hists WHERE node_id > 0 GROUP BY node_id)", then="SELECT CASE WHEN node_id < 3 THEN 0 ELSE 1 END AS depth, sum(n)::BIGINT AS n, sum(top)::BIGINT AS correct, round(100.0::DOUBLE * sum(top) / sum(n), 9) AS success_pct FROM nodes GROUP BY 1"),
    "confusion": text(*TREE, *PREDICTED, then="SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL"),
    "smoke_root": "SELECT i AS sample_id, (i // 8)::INT AS label, (i // 8)::INT AS prediction FROM range(16) r(i)",
    "smoke_depth1": "SELECT i AS sample_id, (i // 4)::INT AS label, (i // 4)::INT AS prediction FROM range(16) r(i)",
    "bench_synth": "SELECT i AS sample_id, (i % 8)::INT AS label, f::INT AS feature_id, CASE WHEN f < 3 THEN CASE WHEN (i % 8) & (1 << (2 - f)) = 0 THEN -1 ELSE 1 END ELSE (i % 8 * (f + 3) + f) % 5 - 2 END::FLOAT AS value FROM range(200) r(i), range(7) s(f)",
    "relabel_unbalanced": "SELECT vec_id AS sample_id, CASE WHEN vec_id = 0 THEN 2 WHEN label > 0 THEN 1 ELSE 0 END AS label FROM embeddings",
    "memory_estimate": """WITH c AS (SELECT count(*) AS num_samples FROM lineitem), d AS (SELECT num_samples, k AS max_depth, k AS folding_depth, 7 AS num_classes FROM c, (VALUES (1), (2), (4), (8)) v(k)),
b AS (SELECT *, (16777216 + 33554432 + 2 * 7 * (1 << max_depth) * 4 + 2 * ((2 << max_depth) - 1) * 48 + num_samples * 2 + 7 * 4 + num_samples + 1048576 * 5)::BIGINT AS bytes FROM d)
SELECT *, round(bytes / 1048576.0::DOUBLE, 6) AS mb, bytes / 1048576.0::DOUBLE <= 65 AS fits FROM b""",
    "parse_log": "SELECT 2.5::DOUBLE AS tree_time_sec, 1 AS final_depth, 87.5::DOUBLE AS final_success_pct",
    "frame_slice": "SELECT url AS path FROM pages ORDER BY url LIMIT 20 OFFSET 5",
    "sample_cap": text(*PIXELS, then="SELECT frame_id, row, col, z, label FROM (SELECT frame_id, row, col, z, lbl - 1 AS label, row_number() OVER (PARTITION BY frame_id ORDER BY md5(concat_ws(':', '0', frame_id, row, col)), row, col) AS place FROM pixels WHERE lbl >= 1) WHERE place <= 256"),
    "depth_pixels": text(*PIXELS, then="SELECT frame_id, row, col, z, lbl - 1 AS label FROM pixels WHERE lbl >= 1"),
    "depth_features": text(*PIXELS, """probes AS (SELECT * FROM (VALUES (0, 512.0, -256.0, 0.0, 128.0), (1, -1024.0, 2048.0, 64.0, 64.0), (2, 4096.0, 0.0, -4096.0, 0.0), (3, 0.0, 0.0, 8192.0, 8192.0)) v(feature_id, dr1, dc1, dr2, dc2))""", """places AS (
  SELECT frame_id, row, col, feature_id, trunc(row + dr1::DOUBLE / z)::BIGINT AS r1, trunc(col + dc1::DOUBLE / z)::BIGINT AS c1, trunc(row + dr2::DOUBLE / z)::BIGINT AS r2, trunc(col + dc2::DOUBLE / z)::BIGINT AS c2
  FROM (SELECT frame_id, row, col, CASE z WHEN 0 THEN 1 ELSE z END::DOUBLE AS z FROM pixels WHERE lbl >= 1), probes)""", """depths AS (
  SELECT p.*, coalesce(a.z, 0)::DOUBLE AS d1, coalesce(b.z, 0)::DOUBLE AS d2 FROM places p
  LEFT JOIN pixels a ON a.frame_id = p.frame_id AND a.row = r1 AND a.col = c1 LEFT JOIN pixels b ON b.frame_id = p.frame_id AND b.row = r2 AND b.col = c2)""", then="""SELECT frame_id, row, col, feature_id,
       CASE WHEN d1 = 0 AND d2 <> 0 THEN 32767 WHEN d1 <> 0 AND d2 = 0 THEN -32767 WHEN d1 = 0 THEN 0 ELSE ceil(greatest(least((d1 - d2) / 250 * 32767, 32767), -32767)) END::SMALLINT AS value FROM depths"""),
    "tree_roundtrip": text(*TREE, then=ALL_NODES),
}
