"""Query op8: fixity of all pages against a replica with planted damage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import table
from arborlake.llm.warc import audit, manifest


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, and whether the replica agrees.

    The replica is the table itself with one byte overwritten in the pages whose
    id leaves 13 divided by 97, as bit rot would.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rotten = F.when(F.col("page_id") % 97 == 13, F.overlay("html", F.lit("~"), 1)).otherwise(F.col("html"))
    return audit(manifest(pages), manifest(pages.withColumn("html", rotten))).withColumnRenamed("key", "page_id")


SQL = r"""
WITH r AS (
  SELECT page_id, page_id // 4096 AS file, coalesce(url, '') AS url, coalesce(html, '') AS html,
         CASE WHEN page_id % 97 = 13 THEN '~' || substr(html, 2) ELSE coalesce(html, '') END AS other
  FROM pages
), w AS (
  SELECT page_id, file,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, other
  FROM r
), s AS (
  SELECT page_id, file, strlen(head || strlen(html) || gap || html || gap) AS length,
         sha256(head || strlen(html) || gap || html || gap) AS sha256,
         sha256(head || strlen(other) || gap || other || gap) AS replica_sha256
  FROM w
)
SELECT file, page_id, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       length, sha256, replica_sha256, CASE WHEN sha256 = replica_sha256 THEN 'ok' ELSE 'changed' END AS status
FROM s
"""
