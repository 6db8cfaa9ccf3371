"""Features of depth frames: differences between two probe pixels, scaled by depth."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.schema import feature_type

#: Difference of depth, in the frames' unit, that saturates a feature.
RANGE = 250.0


def synthetic_frames(spark: SparkSession, count: int, size: int = 32) -> DataFrame:
    """(frame_id, height, width, depth, lbl): a slanted plane with a labelled square."""
    pixels = F.sequence(F.lit(0), F.lit(size * size - 1))
    row, col = lambda i: F.floor(i / size).cast("int"), lambda i: (i % size).cast("int")
    inside = lambda i: row(i).between(4, 27) & col(i).between(4, 27)
    depth = F.transform(pixels, lambda i: F.when(inside(i), 450 + row(i) * 4 + col(i) * 2 + F.col("frame_id") * 7).otherwise(0).cast("float"))
    label = F.transform(pixels, lambda i: F.when(inside(i), (F.floor(row(i) / 4) + F.floor(col(i) / 5) + F.col("frame_id")) % 7 + 1).otherwise(0).cast("int"))
    frames = spark.range(count).select(F.col("id").cast("int").alias("frame_id"))
    return frames.select("frame_id", F.lit(size).alias("height"), F.lit(size).alias("width"), depth.alias("depth"), label.alias("lbl"))


def labelled_pixels(frames: DataFrame) -> DataFrame:
    """(frame_id, row, col, z, label) of pixels with a label; labels start at 0."""
    pixels = frames.select("frame_id", "width", "depth", F.posexplode("lbl").alias("pixel", "lbl")).where("lbl >= 1")
    row, col = F.floor(F.col("pixel") / F.col("width")).cast("int"), (F.col("pixel") % F.col("width")).cast("int")
    return pixels.select("frame_id", row.alias("row"), col.alias("col"), F.get("depth", F.col("pixel")).alias("z"), (F.col("lbl") - 1).alias("label"))


def cap_samples(pixels: DataFrame, most: int | None, seed: int = 0, multiple: int = 1) -> DataFrame:
    """At most ``most`` pixels a frame, drawn by MD5 of seed, frame and place; the rest of a multiple is left out on request."""
    rank, every = (next(n for n in (f"cap_{k}{'_' * i}" for i in range(len(pixels.columns) + 1)) if n not in pixels.columns) for k in ("rank", "every"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "frame_id", "row", "col").cast("binary"))
    order = Window.partitionBy("frame_id").orderBy(draw, "row", "col")
    ranked = pixels.withColumn(rank, F.row_number().over(order)).withColumn(every, F.count("*").over(Window.partitionBy("frame_id")))
    limit = F.col(every) if most is None else F.least(F.col(every), F.lit(most))
    return ranked.where(F.col(rank) <= limit - limit % multiple).drop(rank, every)


def probe_coords(num_features: int, probe_size: float, seed: int) -> list[tuple[int, float, float, float, float]]:
    """(feature_id, dr1, dc1, dr2, dc2): first points on rings of growing radius, second near the middle.

    A ring's point is moved once at random along its ring; all turns rotate that point.
    """
    rings, steepness = 20, 1.3
    if num_features % rings:
        raise ValueError(f"the number of features must be a multiple of {rings}")
    rng, rotations = np.random.default_rng(seed), num_features // rings
    profile = np.exp(np.linspace(-steepness, 0.0, rings + 1))
    radii = rng.permutation(probe_size * (profile - profile[0])[1:] / (1 - profile[0]) / 2)
    step = 2 * math.pi / rotations
    own = [step * (ring / rings + rng.random() / 2) for ring in range(rings)]
    out = []
    for turn in range(rotations):
        for ring in range(rings):
            angle = step * (turn + 1) + own[ring]
            near = (rng.random(2) - 0.5) * 0.1 * probe_size
            out.append((len(out), -math.sin(angle) * radii[ring], math.cos(angle) * radii[ring], float(near[0]), float(near[1])))
    return [tuple(float(np.float32(x)) if i else x for i, x in enumerate(row)) for row in out]


def depth_features(frames: DataFrame, coords: list[tuple[int, float, float, float, float]], type_name: str, most: int | None = None, seed: int = 0) -> DataFrame:
    """(frame_id, row, col, label, features) of labelled pixels.

    A probe is an index into the frame's own array, so pixels never meet other
    frames.  Missing depth is 0; one missing probe saturates the feature.
    """
    kind, _, _, top = feature_type(type_name)
    pixels = labelled_pixels(frames)
    if most is not None:
        pixels = cap_samples(pixels, most, seed)
    rows = pixels.join(frames.select("frame_id", "height", "width", "depth"), "frame_id")
    z = F.when(F.col("z") == 0, F.lit(1.0)).otherwise(F.col("z").cast("double"))

    def at(dr: Column, dc: Column) -> Column:
        r, c = (F.col("row") + dr / z).cast("bigint"), (F.col("col") + dc / z).cast("bigint")
        inside = (r >= 0) & (r < F.col("height")) & (c >= 0) & (c < F.col("width"))
        return F.when(inside, F.get("depth", (r * F.col("width") + c).cast("int"))).otherwise(F.lit(0.0)).cast("double")

    def value(a: Column, b: Column) -> Column:
        scaled = F.ceil(F.greatest(F.least((a - b) / RANGE * top, F.lit(top)), F.lit(-top)))
        return F.when((a == 0) & (b != 0), F.lit(top)).when((a != 0) & (b == 0), F.lit(-top)).when((a == 0) & (b == 0), F.lit(0.0)).otherwise(scaled).cast(kind)

    # one lambda for all probes, so the plan does not grow with their number
    probes = F.array(*[F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("dr1", "dc1", "dr2", "dc2"), c[1:], strict=True)]) for c in coords])
    seen = F.transform(probes, lambda p: F.struct(at(p.dr1, p.dc1).alias("a"), at(p.dr2, p.dc2).alias("b")))
    return rows.select("frame_id", "row", "col", "label", F.transform(seen, lambda d: value(d.a, d.b)).alias("features"))


def chunked(frames: DataFrame, coords: list, type_name: str, chunk: int) -> DataFrame:
    """As ``depth_features``, with features computed in chunks that are then joined end to end."""
    parts = [depth_features(frames, coords[i : i + chunk], type_name).withColumnRenamed("features", f"part{i}") for i in range(0, len(coords), chunk)]
    joined = reduce(lambda a, b: a.join(b, ["frame_id", "row", "col", "label"]), parts)
    return joined.select("frame_id", "row", "col", "label", F.concat(*[F.col(f"part{i}") for i in range(0, len(coords), chunk)]).alias("features"))
