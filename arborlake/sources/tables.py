"""Datasets, trees, logs and frames as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.plans.tree import Tree


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only where the session is a single process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_samples(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; an existing dataset is kept unless ``overwrite``."""
    samples.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_frames(samples: DataFrame, path: str) -> None:
    """Add the samples of more frames, partitioned by frame."""
    samples.write.mode("append").partitionBy("frame_id").parquet(path)


def write_tree(tree: Tree, path: str) -> None:
    """A snapshot: nodes, hists and leaves, replaced as a whole."""
    for name in ("nodes", "hists", "leaves"):
        getattr(tree, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_tree(spark: SparkSession, path: str) -> Tree:
    nodes, hists, leaves = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "hists", "leaves"))
    deepest = nodes.agg(F.max("node_id")).first()[0]
    return Tree((deepest + 2).bit_length() - 2, nodes, hists, leaves)


def frame_slice(files: DataFrame, start: int, most: int | None = None) -> DataFrame:
    """Names in order, from ``start`` on, at most ``most``."""
    rows = files.orderBy("path").offset(start)
    return rows if most is None else rows.limit(most)


def list_frames(spark: SparkSession, path: str, pattern: str = "Data_*.mat") -> DataFrame:
    """Frame files below a directory, without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def unzip(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, name, content) of the members of zip archives, one archive a task."""
    import io
    import zipfile

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for archive, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(body.as_py())) as z:
                    for name in sorted(z.namelist()):
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["archive", "name", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, content binary")


def untar(spark: SparkSession, path: str, pattern: str = "*.tar*") -> DataFrame:
    """(archive, name, content) of the files in tar archives, compressed or not, one archive a task."""
    import io
    import tarfile

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for archive, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with tarfile.open(fileobj=io.BytesIO(body.as_py())) as t:
                    for member in t:
                        if member.isfile():
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member.name]), pa.array([t.extractfile(member).read()], pa.binary())], names=["archive", "name", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, content binary")


def open_frames(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of frame files from a directory or from zip or tar archives, by the path."""
    if path.lower().endswith(".zip"):
        return unzip(spark, path).select("name", "content")
    if path.lower().endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        return untar(spark, path, "*").where(F.col("name").endswith(".mat")).select("name", "content")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "Data_*.mat").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("name"), "content")


# Lines of run logs.
TREE_TIME = r"Processed Tree \d+ in ([0-9]*\.?[0-9]+)s"
DEPTH_LINE = r"Depth (\d+): ([0-9]*\.?[0-9]+)%"


def parse_log(lines: DataFrame) -> DataFrame:
    """(line_no, value) text lines -> tree_time_sec, final_depth, final_success_pct; the last match wins."""
    time, depth, share = F.regexp_extract("value", TREE_TIME, 1), F.regexp_extract("value", DEPTH_LINE, 1), F.regexp_extract("value", DEPTH_LINE, 2)
    rows = lines.select("line_no", time.alias("time"), depth.alias("depth"), share.alias("share"))
    pick = lambda c, kind: F.max_by(F.when(F.col(c) != "", F.col(c)).cast(kind), F.when(F.col(c) != "", F.col("line_no")))
    return rows.agg(pick("time", "double").alias("tree_time_sec"), pick("depth", "int").alias("final_depth"), pick("share", "double").alias("final_success_pct"))


def write_benchmark(rows: DataFrame, path: str) -> None:
    """Benchmark results as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)
