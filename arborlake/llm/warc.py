"""WARC records and a Merkle fixity audit of replicas.

Records are laid into archive files in key order; sums over record lengths,
never payloads, give offsets.  Leaves hash the records that start in one range
of offsets, inner nodes hash ``FANOUT`` children, and a file's root is the node
above all of its ranges.  An audit compares roots, then only children of nodes
that differ, down to ranges and the records in them.

Defined cases: null url or html count as empty; a very long page is one record,
of which only length and hash leave the task that reads it; a null key sorts first, in file
-1; records that repeat a key are ordered by hash, so equal ones are
interchangeable; records only one side has are ``missing`` or ``extra``; an
empty table has no files; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.common import cut, quoted

#: Keys in one archive file.
FILE_KEYS = 4096
#: Bytes of offsets in one leaf.
RANGE_BYTES = 32 << 10
FANOUT = 16
#: Hexadecimal digits of a record's hash that divide the records of one key into parts.
PART_DIGITS = 3


def warc_record(key: Column, url: Column, html: Column) -> Column:
    """The bytes of one response record, as a string."""
    body = F.coalesce(html, F.lit(""))
    size = F.octet_length(body).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(file, key, offset, length, sha256) of every record; payloads stay where they are read.

    Equal records of a key are counted before the shuffle and laid side by side at the end.  Offsets
    add up in three steps, within a key's part of hashes, over a key's parts and over a file's keys, so
    neither a null key nor one that repeats puts its records into one task.
    """
    record = warc_record(quoted(key), quoted(url), quoted(html))
    rows = pages.select(quoted(key).alias("key"), record.alias("r")).select("key", F.octet_length("r").cast("bigint").alias("length"), F.sha2(F.col("r").cast("binary"), 256).alias("sha256"))
    file = F.coalesce(F.floor(F.col("key") / FILE_KEYS).cast("bigint"), F.lit(-1))
    rows = rows.withColumn("file", file).withColumn("part", F.substring("sha256", 1, PART_DIGITS))
    copies = rows.groupBy("file", "key", "part", "sha256", "length").agg(F.count("*").alias("copies"))
    ahead = lambda size, by, at: F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    parts = copies.groupBy("file", "key", "part").agg(F.sum(F.col("length") * F.col("copies")).alias("bytes"))
    keys = parts.groupBy("file", "key").agg(F.sum("bytes").alias("bytes")).select("file", "key", ahead("bytes", ["file"], "key").alias("key_start"))
    same_key = lambda a, b: (F.col(f"{a}.file") == F.col(f"{b}.file")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))
    starts = parts.withColumn("part_start", ahead("bytes", ["file", "key"], "part")).alias("p").join(keys.alias("k"), same_key("p", "k"))
    starts = starts.select("p.file", "p.key", "p.part", (F.col("part_start") + F.col("key_start")).alias("start"))
    placed = copies.withColumn("own", ahead(F.col("length") * F.col("copies"), ["file", "key", "part"], "sha256")).alias("c")
    placed = placed.join(starts.alias("s"), same_key("c", "s") & (F.col("c.part") == F.col("s.part")))
    placed = placed.select("c.file", "c.key", (F.col("start") + F.col("own")).alias("first"), "length", "sha256", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("nth"))
    return placed.select("file", "key", (F.col("first") + F.col("nth") * F.col("length")).alias("offset"), "length", "sha256")


def hashed(groups: DataFrame, at: str, hash_of: Column) -> DataFrame:
    """One node a group, from its ordered members' hashes."""
    return groups.groupBy("file", "node").agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), hash_of.alias("h")))).alias("all")).select("file", "node", F.sha2(F.array_join(F.transform("all", lambda x: F.concat_ws(":", x.at.cast("string"), x.h)), "\n").cast("binary"), 256).alias("h"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of all files' trees, ranges first; the last has one node, 0, a file."""
    named = records.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("bigint"))
    levels = [hashed(named, "offset", F.concat_ws("/", F.col("key").cast("string"), F.col("length").cast("string"), "sha256"))]
    last = records.agg(F.max("offset")).first()[0] or 0
    width = last // RANGE_BYTES
    while width:
        below = levels[-1].select("file", F.floor(F.col("node") / FANOUT).cast("bigint").alias("node"), F.col("node").alias("child"), "h")
        levels.append(hashed(below, "child", F.col("h")))
        width //= FANOUT
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Manifests of two replicas -> the primary's records (and extra ones) with ``status``.

    ok, changed (same key, other bytes), missing, extra, or moved (same bytes
    elsewhere).  Records of branches that agree are never compared.
    """
    primary, replica = cut(primary), cut(replica)
    ours, theirs = tree(primary), tree(replica)
    while len(ours) < len(theirs):
        ours.append(hashed(ours[-1].select("file", F.lit(0).cast("bigint").alias("node"), F.col("node").alias("child"), "h"), "child", F.col("h")))
    while len(theirs) < len(ours):
        theirs.append(hashed(theirs[-1].select("file", F.lit(0).cast("bigint").alias("node"), F.col("node").alias("child"), "h"), "child", F.col("h")))
    differing = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if differing is not None:
            parent = differing.select("file", F.col("node").alias("parent"))
            a, b = (x.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("bigint")).join(parent, ["file", "parent"], "left_semi").drop("parent") for x in (a, b))
        both = a.join(b.withColumnRenamed("h", "other"), ["file", "node"], "full_outer")
        differing = cut(both.where(~F.col("h").eqNullSafe(F.col("other"))).select("file", "node"))
    named = lambda x: x.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("bigint"))
    near_a, near_b = (named(x).join(differing, ["file", "node"], "left_semi") for x in (primary, replica))
    pick = Window.partitionBy("file", "key").orderBy("sha256", "offset")
    a = near_a.withColumn("nth", F.row_number().over(pick)).select("file", "key", "nth", "offset", "length", "sha256")
    b = near_b.withColumn("nth", F.row_number().over(pick)).select(F.col("file").alias("f2"), F.col("key").alias("k2"), F.col("nth").alias("n2"), F.col("offset").alias("o2"), F.col("length").alias("l2"), F.col("sha256").alias("s2"))
    pairs = a.join(b, (F.col("file") == F.col("f2")) & F.col("key").eqNullSafe(F.col("k2")) & (F.col("nth") == F.col("n2")), "full_outer")
    status = F.when(F.col("s2").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("sha256") != F.col("s2"), "changed").when(F.col("offset") != F.col("o2"), "moved").otherwise("ok")
    bad = pairs.select(F.coalesce("file", "f2").alias("file"), F.when(F.col("sha256").isNull(), F.col("k2")).otherwise(F.col("key")).alias("key"), F.coalesce("offset", "o2").alias("offset"), F.coalesce("length", "l2").alias("length"), F.coalesce("sha256", "s2").alias("sha256"), F.col("s2").alias("replica_sha256"), status.alias("status"))
    good = named(primary).join(differing, ["file", "node"], "left_anti").select("file", "key", "offset", "length", "sha256", F.col("sha256").alias("replica_sha256"), F.lit("ok").alias("status"))
    return good.unionByName(bad)
