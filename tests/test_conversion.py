"""Files of frames, large raw files, snapshots, the run log and conversion from end to end."""

import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions.whole import ceil_div, snap_down
from arborlake.operators import datasets, depth, evaluate, sizing
from arborlake.plans.convert import convert
from arborlake.plans.runlog import RunLog
from arborlake.plans.tree import fit
from arborlake.sources import raw, tables


@pytest.mark.parametrize("count", [50, 53, 4096])
@pytest.mark.parametrize("kind", ["F_CHAR", "F_INT"])
def test_large_files_are_read_in_blocks(spark, tmp_path, monkeypatch, kind, count):
    columns = np.random.default_rng(count).integers(-100, 100, (2, count)).astype(raw.FORMATS[kind])
    for f, c in enumerate(columns):
        c.tofile(tmp_path / f"F_{f:04d}.feat")
    whole = sorted(map(tuple, raw.read_features(spark, str(tmp_path), kind).collect()))
    monkeypatch.setattr(raw, "WHOLE", 20)
    monkeypatch.setattr(raw, "BLOCK", 16)
    assert sorted(map(tuple, raw.read_features(spark, str(tmp_path), kind).collect())) == whole == [(f, i, columns[f][i]) for f in range(2) for i in range(count)]
    if kind == "F_INT":
        (tmp_path / "F_0001.feat").write_bytes(b"x" * 41)
        with pytest.raises(ValueError, match="whole number"):
            raw.read_features(spark, str(tmp_path), kind)


def test_snapshot_is_read_again(spark, tmp_path):
    rows, meta, deep = datasets.smoke(spark, "depth1")
    tree = fit(rows, deep, 4, meta=meta)
    (tmp_path / "t").write_bytes(raw.tree_bytes(tree, 4))
    again = raw.read_tree_bytes(spark, str(tmp_path / "t"))
    pick = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert again.max_depth == 1 and pick(again.nodes, "node_id", "feature_id", "threshold") == pick(tree.nodes, "node_id", "feature_id", "threshold")
    assert pick(again.leaves, "node_id", "label", "max_val") == pick(tree.leaves, "node_id", "label", "max_val")
    assert pick(again.hists, "node_id", "label", "n_byte") == pick(evaluate.byte_histogram(tree.hists).where("n_byte > 0"), "node_id", "label", "n_byte")
    assert pick(again.predict(rows), "sample_id", "prediction") == pick(tree.predict(rows), "sample_id", "prediction")
    (tmp_path / "t").write_bytes(raw.tree_bytes(tree, 4)[:-1])
    with pytest.raises(ValueError, match="header"):
        raw.read_tree_bytes(spark, str(tmp_path / "t"))


@pytest.mark.parametrize("suffix", ["tar", "tar.gz"])
def test_frames_of_a_directory_and_a_tar(spark, tmp_path, suffix):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "Data_1.mat").write_bytes(b"one")
    (tmp_path / "in" / "deep" / "Data_2.mat").write_bytes(b"two")
    (tmp_path / "in" / "notes.txt").write_bytes(b"no")
    archive = tmp_path / f"a.{suffix}"
    with tarfile.open(archive, "w:gz" if suffix.endswith("gz") else "w") as t:
        t.add(tmp_path / "in", "in")
    named = lambda rows: {(r.name.rsplit("/", 1)[-1], bytes(r.content)) for r in rows.collect()}
    want = {("Data_1.mat", b"one"), ("Data_2.mat", b"two")}
    assert named(tables.open_frames(spark, str(archive))) == want == named(tables.open_frames(spark, str(tmp_path / "in")))
    assert {r.length for r in tables.list_frames(spark, str(tmp_path / "in")).collect()} == {3}


def test_run_log(spark, tmp_path, capsys):
    rows, meta, deep = datasets.smoke(spark, "depth1")
    tree = fit(rows, deep, 4, meta=meta)
    assert sorted(map(tuple, evaluate.progress(tree.hists).collect())) == [(0, 16, 8, 50.0), (1, 16, 16, 100.0)]
    path = str(tmp_path / "run.log")
    log = RunLog(path, "LOG0")
    log.write("ERROR", "Depth x")
    log.write("LOG1", "not shown")
    log.tree(tree, 0, 1.25)
    RunLog(path).write("LOG2", "appended")
    lines = open(path, encoding="utf-8").read().splitlines()
    assert len(lines) == 5 and lines[-1].endswith(" LOG2: \t\tappended") and " ERROR: Depth x" in lines[0]
    assert capsys.readouterr().err.splitlines() == lines
    assert tuple(tables.parse_log(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string")).first()) == (1.25, 1, 100.0)
    with pytest.raises(ValueError):
        log.write("LOG9", "x")


def test_conversion(spark, tmp_path):
    frames, path = depth.synthetic_frames(spark, 3), str(tmp_path / "out")
    meta = json.loads(convert(spark, frames, path, 20, 500.0, "F_CHAR", seed=2, samples_per_frame=100).first().metadata)
    coords = depth.probe_coords(20, 500.0, 2)
    want = depth.depth_features(frames, coords, "F_CHAR", 100, 2)
    pick = lambda df: sorted((r.frame_id, r.row, r.col, r.label, *r.features) for r in df.collect())
    got = pick(spark.read.parquet(f"{path}/samples"))
    assert got == pick(want) and meta["samples"] == len(got) == 300 and sum(meta["label_hist"].values()) == 300 and meta["seed"] == 2
    assert sorted(map(tuple, spark.read.parquet(f"{path}/coords").collect())) == coords
    x = np.array([r[4:] for r in got], float)
    for r in spark.read.parquet(f"{path}/thresholds").collect():
        valid = x[:, r.feature_id][abs(x[:, r.feature_id]) != 127]
        assert (r.max_proxy, r.fmin, r.fmax) == ((127, valid.min(), valid.max()) if len(valid) else (127, -127, 127))
    with pytest.raises(Exception, match="(?i)exists"):
        convert(spark, frames, path, 20)
    assert json.loads(convert(spark, frames, path, 20, overwrite=True).first().metadata)["samples"] == 3 * 576


def test_whole_numbers_and_required_fit(spark):
    rows = spark.createDataFrame([(a, b) for a in (0, 1, 6, 7, 8, 2**53 + 1) for b in (1, 7, 1000)], "a bigint, b bigint")
    for r in rows.select("a", "b", ceil_div(F.col("a"), F.col("b")).alias("up"), snap_down(F.col("a"), F.col("b")).alias("down")).collect():
        assert (r.up, r.down) == (-(-r.a // r.b), r.a // r.b * r.b)
    cases = sizing.estimates(spark.createDataFrame([(1000, 2, 2, 7)], "num_samples bigint, max_depth int, folding_depth int, num_classes int"), "F_CHAR", cap_mb=1.0)
    with pytest.raises(SystemExit) as stop:
        sizing.require_fit(cases)
    assert stop.value.code == 2 and sizing.require_fit(cases.withColumn("fits", F.lit(True))).count() == 1
