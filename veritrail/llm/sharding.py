"""Contiguous shards of near-equal bytes from global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running, table

N_SHARDS = 16


def balanced_shards(docs: DataFrame, scratch: Scratch, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The rows are put in the order of doc_id (nulls first; equal ids by checksum, then size) and cut
    where the running sum of sizes passes each multiple of total / n_shards: a row belongs to the
    shard that holds its middle byte, so a cut is off by half a row at most. Sizes are UTF-8 bytes
    plus 1. Only ids and numbers are shuffled, never texts.

    Null text counts as empty (size 1, checksum 0). Repeated rows each get a slot. An empty table
    gives no rows. A text larger than a whole share leaves some shards empty. Extra columns are
    ignored. The law is ``bytes``; grown_shard is null.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = running(sized, scratch, [], ["doc_id", "text_crc32", "size"], "size")
    shard = F.least(F.lit(n_shards - 1), F.expr(f"((2 * before + size) * {n_shards}) div (2 * group_total)")).cast("int")
    cut = scratch.keep(placed.select("doc_id", "size", "text_crc32", "idx", shard.alias("shard")), "shards")
    first = cut.groupBy("shard").agg(F.min("idx").alias("first_idx"))  # n_shards rows
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("idx") - F.col("first_idx")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"), Scratch(spark))
