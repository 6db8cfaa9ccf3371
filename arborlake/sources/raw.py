"""Raw binary datasets: a file per feature column, labels, threshold metadata, trees.

Files are listed and split by Spark, so any file system it knows works.  A file
holds one column; its values get their position as ``sample_id``, and short or
missing files are errors.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.plans.tree import Tree
from arborlake.schema import SPLITS, feature_type

# File names and little-endian number formats of the dataset layout.
LABELS, THRESHOLDS, WEIGHTS = "Labels.lbl", "Threshholds.thr", "Weights.txt"
FEATURE_FILE = r"F_(\d+)\.feat$"
FORMATS = {"F_CHAR": "<i1", "F_SHORT": "<i2", "F_INT": "<i4", "F_FLOAT": "<f4"}


#: Files up to this size are read whole by one task; larger ones in blocks of at most ``BLOCK`` values.
WHOLE, BLOCK = 1 << 28, 1 << 16


def _blocks(spark: SparkSession, path: str, length: int, form: str) -> DataFrame:
    """(path, start, content) of one large file, split among tasks into records of equal size.

    The input format takes no shorter last record, so a block holds the largest number of values
    up to ``BLOCK`` that divides the file's; a prime number of values is read value by value.
    """
    width = np.dtype(form).itemsize
    if length % width:
        raise ValueError(f"{path}: {length} bytes are not a whole number of values")
    size = width * next(d for d in range(BLOCK, 0, -1) if length // width % d == 0)
    hadoop = "org.apache.hadoop."
    rows = spark.sparkContext.newAPIHadoopFile(path, hadoop + "mapreduce.lib.input.FixedLengthInputFormat", hadoop + "io.LongWritable", hadoop + "io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(size)})
    return spark.createDataFrame(rows, "start bigint, content binary").select(F.lit(path).alias("path"), "start", "content")


def _values(spark: SparkSession, path: str, pattern: str, form: str, kind: str) -> DataFrame:
    """(path, pos, value) of all numbers in the files that match."""

    def run(batches):
        for batch in batches:
            for name, start, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = body.as_py()
                if len(data) % np.dtype(form).itemsize:
                    raise ValueError(f"{name}: {len(data)} bytes are not a whole number of values")
                x, first = np.frombuffer(data, form), start // np.dtype(form).itemsize
                for i in range(0, len(x), 1 << 20):
                    part = x[i : i + (1 << 20)]
                    value = pa.array(part.astype(part.dtype.newbyteorder("=")))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(first + i, first + i + len(part))), value.cast(target)], names=["path", "pos", "value"])

    target = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "float": pa.float32()}[kind]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    rows = files.where(F.col("length") <= WHOLE).select("path", F.lit(0).cast("bigint").alias("start"), "content")
    for large in files.where(F.col("length") > WHOLE).select("path", "length").collect():  # one row a feature at most
        rows = rows.unionByName(_blocks(spark, large.path, large.length, form))
    return rows.mapInArrow(run, f"path string, pos bigint, value {kind}")


def read_features(spark: SparkSession, path: str, type_name: str, num_features: int | None = None) -> DataFrame:
    """(feature_id, sample_id, value) of all feature files, or the first ``num_features``."""
    rows = _values(spark, path, "F_*.feat", FORMATS[type_name], feature_type(type_name)[0])
    rows = rows.select(F.regexp_extract("path", FEATURE_FILE, 1).cast("int").alias("feature_id"), F.col("pos").alias("sample_id"), "value")
    return rows if num_features is None else rows.where(F.col("feature_id") < num_features)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, label)."""
    rows = _values(spark, path, LABELS, "<u2", "int")
    return rows.select(F.col("pos").alias("sample_id"), F.col("value").alias("label"))


def read_threshold_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, max_proxy, fmin, fmax) from triples of floats."""
    rows = _values(spark, path, THRESHOLDS, "<f4", "float").withColumn("feature_id", F.floor(F.col("pos") / 3).cast("int"))
    pick = lambda k: F.max(F.when(F.col("pos") % 3 == k, F.col("value")))
    return rows.groupBy("feature_id").agg(pick(0).alias("max_proxy"), pick(1).alias("fmin"), pick(2).alias("fmax"))


def read_dataset(spark: SparkSession, path: str, type_name: str, num_features: int | None = None, num_samples: int | None = None) -> DataFrame:
    """(sample_id, label, features): all columns aligned by position.

    A feature that is shorter than the labels, or missing, is an error.
    """
    labels = read_labels(spark, path)
    if num_samples is not None:
        labels = labels.where(F.col("sample_id") < num_samples)
    values = read_features(spark, path, type_name, num_features)
    count = values.agg(F.countDistinct("feature_id"), F.max("feature_id")).first()
    if not count[0] or count[0] != count[1] + 1 or (num_features and count[0] != num_features):
        raise ValueError(f"{path}: feature files are missing")
    wide = values.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("feature_id", "value"))).alias("v"))
    wide = wide.select("sample_id", F.transform("v", lambda x: x.value).alias("features"))
    joined = labels.join(wide, "sample_id", "left")
    short = F.coalesce(F.size("features"), F.lit(0)) != count[0]
    return joined.select("sample_id", "label", F.when(short, F.raise_error(F.lit("a feature file is too short"))).otherwise(F.col("features")).alias("features"))


def tree_bytes(tree: Tree, num_classes: int) -> bytes:
    """A trained tree in the reference layout of snapshots: header, splits, leaf records, byte histograms.

    The tree has at most a few thousand nodes, so it is assembled on the driver.
    """
    from arborlake.operators.evaluate import byte_histogram, majority

    splits = tree.nodes.orderBy("node_id").collect()
    total = len(splits)
    records = 2 * total + 1
    tops = {r.node_id: (r.max_val, r.label) for r in majority(tree.hists).collect()}
    small = {(r.node_id, r.label): r.n_byte for r in byte_histogram(tree.hists).collect()}
    out = [struct.pack("<4i", total, records, num_classes, tree.max_depth)]
    out += [struct.pack("<if", s.feature_id, s.threshold) for s in splits]
    out += [struct.pack("<IHxx", *tops.get(n, (0, 0))) for n in range(records)]
    out.append(bytes(small.get((n, c), 0) for n in range(records) for c in range(num_classes)))
    return b"".join(out)


def read_tree_bytes(spark: SparkSession, path: str) -> Tree:
    """The tree of a snapshot file.

    Gains, entropies and counts of splits are not in it and are null; its histograms hold bytes,
    so ``hists`` has (node_id, label, n_byte) instead of counts.
    """
    body = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    total, records, classes, deep = struct.unpack_from("<4i", body)
    at = 16 + 8 * total
    if len(body) != at + records * (8 + classes):
        raise ValueError(f"{path}: {len(body)} bytes do not fit the header")
    splits = [(n, f, None, t, *[None] * 5) for n, (f, t) in enumerate(struct.iter_unpack("<if", body[16:at]))]
    tops = list(struct.iter_unpack("<IHxx", body[at : at + 8 * records]))
    small = np.frombuffer(body, "u1", offset=at + 8 * records).reshape(records, classes)
    hists = [(int(n), int(c), int(small[n, c])) for n, c in zip(*small.nonzero(), strict=True)]
    leaves = [(n, int(label), int(most)) for n, (most, label) in enumerate(tops) if n >= total]
    return Tree(deep, spark.createDataFrame(splits, SPLITS), spark.createDataFrame(hists, "node_id bigint, label int, n_byte smallint"), spark.createDataFrame(leaves, "node_id bigint, label int, max_val bigint"))
