"""Contiguous shards of nearly equal bytes, cut on global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import table
from wayline.llm.prefix import running_totals

SHARDS, OVERHEAD = 40, 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Documents stand in the order of doc_id (nulls first), text checksum and size. The byte line is cut at `shards` equal
    targets and a document goes where its middle byte falls, so each shard is contiguous and its bytes differ from the
    target by less than one document at either end. `slot` counts from 0 within the shard. A null text has no bytes and
    the checksum 0; repeated rows each get a place; an empty table gives no rows; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = running_totals(sized, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "size")
    total = placed.agg(F.max(F.col("_start") + F.col("size"))).first()[0] or 0
    cut_at = F.expr(f"(2 * _start + size) * {shards} div {max(2 * total, 1)}L")
    dealt = placed.withColumn("shard", F.least(cut_at, F.lit(shards - 1)).cast("int"))
    firsts = dealt.groupBy("shard").agg(F.min("_row").alias("_first"))
    return dealt.join(F.broadcast(firsts), "shard").select(  # at most `shards` rows
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )


#: DuckDB SQL of `op7_sharding`. It has no crc32, so that is worked out byte by byte with the table of its polynomial.
ORACLE = f"""WITH t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, length(x) // 2 + {OVERHEAD} AS size, list_transform(regexp_extract_all(x, '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bytes FROM h),
d AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS text_crc32 FROM b, t),
l AS (
  SELECT *, sum(size) OVER o - size AS start, sum(size) OVER () AS total, row_number() OVER o AS place FROM d
  WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least({SHARDS} - 1, (2 * start + size) * {SHARDS} // greatest(2 * total, 1)) AS INT) AS shard FROM l)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
