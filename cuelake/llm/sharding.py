"""Contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, prefix_sums

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, and byte_start.

    Rows are put in the order (doc_id, text_crc32, size), nulls first; a row's
    byte_start is the sum of all sizes before it, made of per-partition totals
    and running sums inside partitions.  Shard k holds the rows whose middle byte
    lies in the k-th of `shards` equal parts of all bytes, so shards are runs of
    that order and differ from the mean by less than one row's size.  slot counts
    from 0 within the shard.  A null text has size 1 and crc32 0.  The law is
    "bytes", so grown_shard is null.  Fewer rows than shards leave some empty; an
    empty table gives an empty result.
    """
    rows = only(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = cut(prefix_sums(rows.withColumn("one", F.lit(1).cast("long")), ["doc_id", "text_crc32", "size"], {"size": "byte_start", "one": "row_number"}), "placed")
    total = placed.agg(F.sum("size")).first()[0] or 1
    shard = F.least(F.lit(shards - 1), F.expr(f"(byte_start * 2 + size) * {shards} div {2 * total}")).cast("int")
    sharded = placed.withColumn("shard", shard)
    starts = F.broadcast(sharded.groupBy("shard").agg(F.min("row_number").alias("first_row")))  # `shards` rows
    return sharded.join(starts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_number") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "byte_start"
    )
