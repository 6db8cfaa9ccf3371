"""Generators, raw files, storage, depth frames, sizing and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import datasets, depth, sizing
from arborlake.plans.tree import fit
from arborlake.schema import SAMPLES, feature_type
from arborlake.sources import raw, tables
from arborlake.streaming.predict import predict_stream


def small(spark, n=10):
    return spark.createDataFrame([(i, i % 3, [float(i), -float(i)]) for i in range(n)], SAMPLES)


def test_tile_and_repeat(spark):
    got = datasets.tile(small(spark), 25).orderBy("sample_id").collect()
    assert [r.sample_id for r in got] == list(range(25)) and [r.label for r in got] == [i % 10 % 3 for i in range(25)]
    assert datasets.tile(small(spark), 4).count() == 4
    wide = datasets.repeat_features(small(spark), 5).where("sample_id = 2").first().features
    assert wide == [2, -2, 2, -2, 2]
    with pytest.raises(ValueError):
        datasets.tile(small(spark, 0), 4)


def test_relabel_modes(spark):
    rows = small(spark, 300)
    for mode, out in (("real", 7), ("uniform", 5), ("unbalanced", 2)):
        made = datasets.relabel(rows, mode, 3, out, seed=4)
        labels = {r.label for r in made.collect()}
        assert labels <= set(range(out)) and out - 1 in labels
        assert sorted(map(tuple, made.select("sample_id", "label").collect())) == sorted(map(tuple, datasets.relabel(rows, mode, 3, out, seed=4).select("sample_id", "label").collect()))
    with pytest.raises(ValueError):
        datasets.relabel(rows, "other", 3, 3)


def test_cast(spark):
    rows = small(spark, 3)
    assert datasets.cast_features(rows, "F_CHAR").schema["features"].dataType.simpleString() == "array<tinyint>"
    with pytest.raises(Exception, match="(?i)overflow"):
        datasets.cast_features(rows.withColumn("features", F.array(F.lit(300.0))), "F_CHAR").collect()
    with pytest.raises(ValueError):
        feature_type("F_LONG")


@pytest.mark.parametrize("kind", ["F_CHAR", "F_SHORT", "F_INT", "F_FLOAT"])
def test_raw_files(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    columns = rng.integers(-100, 100, (3, 50)).astype(raw.FORMATS[kind])
    for f, c in enumerate(columns):
        c.tofile(tmp_path / f"F_{f:04d}.feat")
    (np.arange(50) % 4).astype("<u2").tofile(tmp_path / raw.LABELS)
    np.array([10, -1, 1, 20, -2, 2], "<f4").tofile(tmp_path / raw.THRESHOLDS)
    got = raw.read_dataset(spark, str(tmp_path), kind, num_samples=20).orderBy("sample_id").collect()
    assert [r.label for r in got] == [i % 4 for i in range(20)]
    assert [r.features for r in got] == columns[:, :20].T.tolist()
    assert sorted(map(tuple, raw.read_threshold_metadata(spark, str(tmp_path)).collect())) == [(0, 10, -1, 1), (1, 20, -2, 2)]
    with pytest.raises(ValueError, match="missing"):
        raw.read_dataset(spark, str(tmp_path), kind, num_features=5)
    columns[1][:30].tofile(tmp_path / "F_0001.feat")
    with pytest.raises(Exception, match="too short"):
        raw.read_dataset(spark, str(tmp_path), kind).collect()


def test_tree_files(spark, tmp_path):
    rows, meta, deep = datasets.smoke(spark, "depth1")
    tree = fit(rows, deep, 4, meta=meta)
    tables.write_tree(tree, str(tmp_path / "t"))
    again = tables.read_tree(spark, str(tmp_path / "t"))
    assert again.max_depth == 1 and sorted(map(tuple, again.nodes.collect())) == sorted(map(tuple, tree.nodes.collect()))
    assert sorted(map(tuple, again.predict(rows).select("sample_id", "prediction").collect())) == sorted(map(tuple, tree.predict(rows).select("sample_id", "prediction").collect()))
    data = raw.tree_bytes(tree, 4)
    assert len(data) == 16 + 3 * 8 + 7 * 8 + 7 * 4 and np.frombuffer(data[:16], "<i4").tolist() == [3, 7, 4, 1]
    assert list(data[-28:-24]) == [255] * 4


def test_overwrite_guard(spark, tmp_path):
    tables.write_samples(small(spark), str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_samples(small(spark), str(tmp_path / "s"))
    tables.write_samples(small(spark, 3), str(tmp_path / "s"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_zip_source(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Data_2.mat", b"two")
        z.writestr("Data_1.mat", b"one")
    got = tables.open_frames(spark, str(tmp_path / "a.zip")).collect()
    assert {(r.name, bytes(r.content)) for r in got} == {("Data_1.mat", b"one"), ("Data_2.mat", b"two")}
    assert [r.name for r in tables.frame_slice(spark.createDataFrame([("b",), ("a",), ("c",)], "path string").withColumn("name", F.col("path")), 1, 1).collect()] == ["b"]


def test_log(spark):
    lines = [(0, "Depth 0: 50.0%"), (1, "Processed Tree 3 in 1.5s"), (2, "Depth 1: 75.25%")]
    assert tuple(tables.parse_log(spark.createDataFrame(lines, "line_no bigint, value string")).first()) == (1.5, 1, 75.25)
    assert tuple(tables.parse_log(spark.createDataFrame([(0, "x")], "line_no bigint, value string")).first()) == (None, None, None)


def test_depth_features_against_numpy(spark):
    frames = depth.synthetic_frames(spark, 2)
    coords = depth.probe_coords(40, 3000.0, 5)
    assert len(coords) == 40
    got = {(r.frame_id, r.row, r.col): r.features for r in depth.depth_features(frames, coords, "F_SHORT").collect()}
    images = {r.frame_id: np.array(r.depth).reshape(32, 32) for r in frames.collect()}
    assert len(got) == 2 * 24 * 24
    for (frame, row, col), features in list(got.items())[::37]:
        image = images[frame]
        z = image[row, col] or 1.0

        def probe(dr, dc):
            r, c = int(row + dr / z), int(col + dc / z)
            return image[r, c] if 0 <= r < 32 and 0 <= c < 32 else 0.0

        for (_, a, b, c, d), v in zip(coords, features, strict=True):
            p, q = probe(a, b), probe(c, d)
            want = 32767 if not p and q else -32767 if p and not q else 0 if not p else np.ceil(np.clip((p - q) / 250 * 32767, -32767, 32767))
            assert v == want
    with pytest.raises(ValueError):
        depth.probe_coords(30, 1.0, 1)
    assert sorted(map(tuple, depth.chunked(frames, coords, "F_SHORT", 16).select("frame_id", "row", "col", F.hash("features")).collect())) == sorted(map(tuple, depth.depth_features(frames, coords, "F_SHORT").select("frame_id", "row", "col", F.hash("features")).collect()))


def test_sample_cap(spark):
    pixels = depth.labelled_pixels(depth.synthetic_frames(spark, 4))
    capped = depth.cap_samples(pixels, 255, seed=1, multiple=4)
    assert {r["count"] for r in capped.groupBy("frame_id").count().collect()} == {252}
    assert {r.label for r in capped.collect()} == set(range(7))


def test_sample_cap_keeps_columns(spark):
    pixels = depth.labelled_pixels(depth.synthetic_frames(spark, 1)).selectExpr("*", "'x' AS rank", "1 AS cap_rank", "2 AS cap_every")
    capped = depth.cap_samples(pixels, 10)
    assert capped.columns == pixels.columns and {(r["rank"], r.cap_rank, r.cap_every) for r in capped.collect()} == {("x", 1, 2)}


def test_probe_coords_rotate():
    """The first points of a turn are those of the turn before, rotated; radii grow to half the probe's size."""
    coords = np.array(depth.probe_coords(60, 1000.0, 7))
    first = coords[:, 1:3].reshape(3, 20, 2)
    angle = 2 * np.pi / 3
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    for k in (1, 2):
        assert np.allclose(first[k], first[k - 1] @ turn.T, atol=1e-2)
    radii = np.sort(np.hypot(*first[0].T))
    profile = (np.exp(np.linspace(-1.3, 0, 21)) - np.exp(-1.3)) / (1 - np.exp(-1.3))
    assert np.allclose(radii, 500 * profile[1:], atol=1e-2)
    jitter = (np.arctan2(-first[0][:, 0], first[0][:, 1]) - angle * (1 + np.arange(20) / 20)) % (2 * np.pi) % (2 * np.pi - 1e-6)
    assert (jitter <= angle / 2 + 1e-6).all() and len(set(jitter.round(4))) > 10 and (abs(coords[:, 3:]) <= 50).all()


def test_frames_are_appended(spark, tmp_path):
    """Frames converted one after the other give the dataset of all of them."""
    path, coords = str(tmp_path / "samples"), depth.probe_coords(20, 500.0, 1)
    for k in range(2):
        tables.append_frames(depth.depth_features(depth.synthetic_frames(spark, 2).where(F.col("frame_id") == k), coords, "F_CHAR", 256), path)
    want = depth.depth_features(depth.synthetic_frames(spark, 2), coords, "F_CHAR", 256)
    rows = lambda df: sorted(map(tuple, df.select("frame_id", "row", "col", "label", F.hash("features")).collect()))
    assert rows(spark.read.parquet(path)) == rows(want) and want.count() == 512


def test_sizes(spark):
    one = sizing.estimate_bytes(19_949_016, 8, 8, 7, "F_CHAR")
    assert one / 1048576 == pytest.approx(110.1, abs=0.1)
    cases = spark.createDataFrame([(19_949_016, 8, 8, 7)], "num_samples bigint, max_depth int, folding_depth int, num_classes int")
    got = sizing.estimates(cases, "F_CHAR", cap_mb=100).first()
    assert got.bytes == one and not got.fits
    sweep = sizing.sweep([3, 1, 2], [8, 64], [1, 4], 8)
    assert len(sweep) == 7 and sweep[0]["name"] == "samples-s1-f64-d4" and sweep[0]["pool_size"] == 32
    assert sizing.int_list("1, 2,,3") == [1, 2, 3]
    with pytest.raises(ValueError):
        sizing.int_list(" , ")


def test_metadata(spark):
    got = json.loads(datasets.metadata_json(small(spark), seed=7, feature_type="F_CHAR").first().metadata)
    assert got == {"seed": 7, "feature_type": "F_CHAR", "samples": 10, "label_hist": {"0": 4, "1": 3, "2": 3}}


def test_prediction_on_a_stream(spark, tmp_path):
    rows, meta, deep = datasets.smoke(spark, "depth1")
    tree = fit(rows, deep, 4, meta=meta)
    rows.write.parquet(str(tmp_path / "in"))
    stream = predict_stream(spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in")), tree)
    run = stream.writeStream.format("memory").queryName("predicted").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("predicted").where("label = prediction").count() == 16
    with pytest.raises(ValueError):
        predict_stream(rows, tree)


def test_sweep_runs_and_refuses(spark, tmp_path):
    from arborlake.plans.sweep import run_sweep

    rows = run_sweep(spark, [64], [4], [1], num_thresholds=4, cap_mb=60)
    got = rows.collect()
    assert {r.suite for r in got} == {"samples", "features", "depths"} and all(r.status == "ok" and r.final_success_pct == 100 for r in got)
    assert {r.status for r in run_sweep(spark, [64], [4], [1], cap_mb=1).collect()} == {"refused"}
    tables.write_benchmark(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
