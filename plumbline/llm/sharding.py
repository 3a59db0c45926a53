"""Contiguous shards of near-equal bytes, cut on global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.prefix import prefix_sums


def shard(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    """Deal docs (doc_id, text) to shards 0 .. shards-1, contiguous in doc_id order.

    A document's size is its text's UTF-8 bytes plus 1 (null text: 1). A shard
    takes the documents whose middle byte lies in its equal part of the total,
    so each cut is at most half a document from its target. slot numbers a
    shard's documents from 0. The law is `bytes`; grown_shard is null.

    The text goes no further than the scan: sizes and checksums alone are
    shuffled. Ties in doc_id are ordered by checksum and size; rows that tie in
    these too are alike. A null doc_id sorts first; a text longer than a shard
    fills one alone. An empty table gives no rows; other columns are ignored.
    """
    scratch = common.Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).withColumn("one", F.lit(1).cast("long"))
    placed = prefix_sums(scratch, rows, [], ["doc_id", "text_crc32", "size"], {"before": "size", "place": "one"})
    placed = scratch.keep(placed, "placed")
    total = placed.agg(F.sum("size")).first()[0] or 1
    # 2 * middle byte * shards stays below 2**63 up to 2**58 bytes a shard count of 16
    middle = F.col("before").cast("decimal(38,0)") * 2 + F.col("size")
    cut = F.least(F.floor(middle * shards / F.lit(2 * total).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1))
    placed = placed.withColumn("shard", cut)
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: Rows-for-rows SQL of the query with 8 shards. crc.t is the table of the reflected polynomial 0xEDB88320 (a fixed value).
SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
c AS (
  SELECT doc_id, size,
         xor(list_reduce(list_prepend(4294967295, [CAST('0x' || b AS BIGINT) FOR b IN regexp_extract_all(hex(encode(text)), '..')]),
                         lambda r, b: xor(r >> 8, crc.t[(xor(r, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc),
p AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER w - size AS before
  FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least((2 * before + size) * 8 // (2 * total), 7) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
