"""Split search and training against hand-made cases and a brute-force version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import datasets, evaluate, weights
from arborlake.operators.histograms import child_histogram, left_histogram, parent_histogram
from arborlake.operators.split import best_split, node_impurity, score_splits
from arborlake.operators.thresholds import candidates, threshold_metadata
from arborlake.plans.tree import fit
from arborlake.schema import SAMPLES, THRESH_META, validated


def rows_of(spark, labels, *columns):
    return spark.createDataFrame([(i, y, [float(c[i]) for c in columns]) for i, y in enumerate(labels)], SAMPLES)


def meta_of(spark, n, top=10.0, low=-1.0, high=1.0):
    return spark.createDataFrame([(f, top, low, high) for f in range(n)], THRESH_META)


def share(tree, rows):
    return evaluate.accuracy(tree.predict(rows)).first()


def test_candidate_values(spark):
    got = [r.threshold for r in candidates(meta_of(spark, 1), 4).orderBy("threshold_id").collect()]
    assert got == pytest.approx([3.99999, -1e-05, -1.00001, 0.99999], abs=1e-6)
    for n in (1, 2, 3):
        assert candidates(meta_of(spark, 2), n).count() == 2 * n
    with pytest.raises(ValueError):
        candidates(meta_of(spark, 1), 0)


def test_smoke_root(spark):
    rows, meta, deep = datasets.smoke(spark, "root")
    tree = fit(rows, deep, 4, meta=meta)
    top = tree.nodes.first()
    assert (top.node_id, top.feature_id, top.threshold_id) == (0, 0, 1)
    assert top.threshold == pytest.approx(-1e-5) and top.gain == pytest.approx(0, abs=1e-4)
    assert share(tree, rows).accuracy == 100
    assert {tuple(r) for r in tree.hists.collect()} == {(0, 0, 8), (0, 1, 8), (1, 0, 8), (2, 1, 8)}


def test_smoke_depth1(spark):
    rows, meta, deep = datasets.smoke(spark, "depth1")
    tree = fit(rows, deep, 4, meta=meta)
    assert [(r.node_id, r.feature_id, r.threshold_id) for r in tree.nodes.orderBy("node_id").collect()] == [(0, 0, 1), (1, 1, 1), (2, 1, 1)]
    assert [r.gain for r in tree.nodes.orderBy("node_id").collect()] == pytest.approx([-1, 1, 1], abs=1e-4)
    assert share(tree, rows).accuracy == 100


def test_unbalanced_classes_keep_their_leaves(spark):
    rows = rows_of(spark, [0] * 4 + [1] * 12, [-1] * 4 + [1] * 12)
    assert share(fit(rows, 0, 4, meta=meta_of(spark, 1)), rows).accuracy == 100


def test_boundaries_of_any_size(spark):
    rows = rows_of(spark, [0] * 4 + [1] * 4 + [2] * 4, [-1] * 4 + [1] * 8, [0] * 4 + [-1] * 4 + [1] * 4)
    assert share(fit(rows, 1, 4, meta=meta_of(spark, 2)), rows).accuracy == 100


@pytest.mark.parametrize("n", [1, 5, 7])
def test_tiny(spark, n):
    rows = rows_of(spark, [i % 2 for i in range(n)], [i for i in range(n)])
    tree = fit(rows, 1, 4)
    assert tree.hists.where("node_id = 0").agg(F.sum("n")).first()[0] == n
    assert tree.nodes.count() == 3 and tree.leaves.count() == 4


def test_empty_nodes_get_a_split(spark):
    rows = rows_of(spark, [0, 0, 1], [5, 5, 5])
    tree = fit(rows, 2, 3)
    assert tree.nodes.count() == 7
    empty = tree.nodes.where("n_left + n_right = 0")
    assert empty.count() and empty.where("feature_id = 0 and threshold_id = 0").count() == empty.count()
    assert tree.leaves.where("max_val = 0 and label = 0").count() == 7


def test_absent_class(spark):
    rows = rows_of(spark, [0, 0, 2, 2], [-1, -1, 1, 1])
    got = evaluate.per_class_accuracy(fit(rows, 0, 4, meta=meta_of(spark, 1)).predict(rows), 3).orderBy("label").collect()
    assert [(r.n, r.accuracy) for r in got] == [(2, 100), (0, None), (2, 100)]


def test_apriori_mass(spark):
    rows = rows_of(spark, [0] * 4 + [1] * 12, [-1] * 4 + [1] * 12).withColumn("node_id", F.lit(0).cast("bigint"))
    got = node_impurity(parent_histogram(rows), weights.apriori(rows)).first()
    assert got.total == 2 and got.impurity == pytest.approx(1, abs=1e-4)
    best = fit(rows.drop("node_id"), 0, 4, meta=meta_of(spark, 1), weight_type="apriori").nodes.first()
    assert best.gain == pytest.approx(1.44e-5, abs=1e-6)


def test_weight_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("0 3\n2 5\n9 9\n2 6\n")
    got = {r.label: r.w for r in weights.from_file(spark, str(tmp_path / "w.txt"), 4).collect()}
    assert got == {0: 3, 1: 1, 2: 6, 3: 1}
    with pytest.raises(Exception, match="(?i)path"):
        weights.from_file(spark, str(tmp_path / "none.txt"), 4).collect()


def test_label_out_of_range(spark):
    rows = rows_of(spark, [0, 1 << 14], [1, 2])
    with pytest.raises(Exception, match="label out of range"):
        validated(rows).collect()


def test_sentinel_range(spark):
    rows = rows_of(spark, [0, 0, 0], [6, -6, 6], [6, 2, -1])
    got = {r.feature_id: (r.fmin, r.fmax) for r in threshold_metadata(rows, 6.0, sentinel=6.0).collect()}
    assert got == {0: (-6, 6), 1: (-1, 2)}


def entropy(counts):
    s = sum(counts)
    return math.log2(s) - sum(n * math.log2(n + 1e-5) for n in counts if n) / s if s else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n, k = 60, 4
    values = [[rng.choice([0.0, 1.0, -1.0, rng.uniform(-2, 2)]) for _ in range(k)] for _ in range(n)]
    labels = [rng.randrange(3) for _ in range(n)]
    rows = rows_of(spark, labels, *[[v[f] for v in values] for f in range(k)]).withColumn("node_id", (F.col("sample_id") % 2).cast("bigint"))
    cands = candidates(threshold_metadata(rows), 6)
    hist = child_histogram(rows, cands)
    both = left_histogram(parent_histogram(rows), hist)
    scores = score_splits(both, weights.ones(rows))
    got = {(r.node_id, r.feature_id, r.threshold_id): r for r in scores.collect()}
    data = [(r.sample_id % 2, r.label, list(r.features)) for r in rows.collect()]
    best = {}
    for c in cands.orderBy("feature_id", "threshold_id").collect():
        for node in (0, 1):
            side = [[0, 0, 0], [0, 0, 0]]
            for at, y, x in data:
                if at == node:
                    side[x[c.feature_id] > c.threshold][y] += 1
            left, right = side
            total = sum(left) + sum(right)
            gain = -(sum(left) * entropy(left) + sum(right) * entropy(right)) / (total + 1e-5)
            r = got[node, c.feature_id, c.threshold_id]
            assert (r.n_left, r.n_right) == (sum(left), sum(right)) and r.gain == pytest.approx(gain, abs=1e-9)
            if node not in best or round(gain, 9) > best[node][0]:
                best[node] = (round(gain, 9), c.feature_id, c.threshold_id)
    assert {(r.node_id, r.feature_id, r.threshold_id) for r in best_split(scores).collect()} == {(k, v[1], v[2]) for k, v in best.items()}


def test_deep_tree_separates_its_own_data(spark):
    rows, meta = datasets.bench_dataset(spark, 256, 6, 3, "F_CHAR")
    tree = fit(rows, 2, 8, meta=meta)
    assert share(tree, rows).accuracy == 100


def test_extra_columns_and_null_features(spark):
    rows = spark.createDataFrame([(0, 0, [None, 1.0], "x"), (1, 1, [1.0, None], "y"), (2, 1, [1.0, 2.0], None)], SAMPLES + ", gain string")
    tree = fit(rows, 0, 4, meta=meta_of(spark, 2))
    assert tree.predict(rows).count() == 3


def test_candidates_beyond_the_broadcast_bound(spark, monkeypatch):
    from arborlake.operators import histograms

    rows = rows_of(spark, [0, 1, 0, 1, 1], [1, 2, 3, 4, 5], [0, 0, -1, 1, 7]).withColumn("node_id", F.lit(0).cast("bigint"))
    cands = candidates(threshold_metadata(rows), 5)
    sent = sorted(map(tuple, child_histogram(rows, cands).collect()))
    monkeypatch.setattr(histograms, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, child_histogram(rows, cands).collect())) == sent
