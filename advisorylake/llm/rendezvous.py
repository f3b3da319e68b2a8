"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from advisorylake.session import Scratch

SHARDS = 24
#: Rows planned for one numbering task.
ROWS_PER_BUCKET = 10_000


def draw(key: Column, shard: int, weight: float) -> Column:
    """Arrival time of a shard at a key: exponential with rate ``weight``; the earliest wins."""
    h = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f":{shard}"))), 11)
    return -F.ln((h + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """struct(time, shard) of the earliest shard; equal times go to the lower number."""
    return F.array_min(F.array(*[F.struct(draw(key, s, w).alias("time"), F.lit(s).alias("shard"))
                                 for s, w in enumerate(weights)]))


def slot_groups(placed: DataFrame, shards: int, rows_per_bucket: int, scratch: Scratch) -> DataFrame:
    """``placed``, a written table, with the bucket and the part of it in which a task numbers a row.

    Buckets follow the content of a row. Rows that are equal in all of it would share one however many they are, so a hash with
    more than ``rows_per_bucket`` rows is a bucket of its own, in several parts by the places of its rows in the written files. Such
    rows can be exchanged for each other, so slots still follow from content alone.
    """
    content = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text_crc32", "size")
    rows = placed.select("*", content.alias("content"), F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("place"))
    large = scratch.write(rows.groupBy("content").count().where(F.col("count") > rows_per_bucket).select(
        "content", F.ceil(F.col("count") / rows_per_bucket).alias("parts")), "large")
    buckets = -(-placed.count() // (shards * rows_per_bucket)) or 1
    return rows.join(large, "content", "left").select(
        *placed.columns, F.when(F.col("parts").isNull(), F.pmod("content", F.lit(buckets))).otherwise(F.col("content")).alias("bucket"),
        F.coalesce(F.pmod("place", "parts"), F.lit(0)).alias("part"))


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0,
           id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: id_col, size, text_crc32, shard, slot, grown_shard.

    Only the key, the text form of the id, decides the shard; a shard's share of the keys is its weight's. With one
    more shard of ``grown_weight`` a row either stays or moves to the new shard (``grown_shard``). ``slot``
    numbers the rows of a shard from 0 without gaps. ``size`` is the UTF-8 length of the text plus 8.

    Null texts are empty, a null id is the empty key, repeated rows share a shard and have
    slots of their own; extra columns are ignored. Weights must be positive.
    """
    if not weights or min(*weights, grown_weight) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    first = rows.withColumn("first", winner(key, weights))
    late = draw(key, len(weights), grown_weight)
    scratch = Scratch(docs.sparkSession, "rendezvous")
    placed = scratch.write(first.select(
        "id", "size", "text_crc32", F.col("first.shard").alias("shard"),
        F.when(late < F.col("first.time"), F.lit(len(weights))).otherwise(F.col("first.shard")).alias("grown_shard")), "placed")
    # Slots are numbered in parts of hash buckets of a shard, so no task sorts a whole shard.
    numbered = slot_groups(placed, len(weights), rows_per_bucket, scratch)
    counts = numbered.groupBy("shard", "bucket", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = scratch.write(counts.select("shard", "bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = W.partitionBy("shard", "bucket", "part").orderBy("id", "text_crc32", "size")
    ranked = numbered.withColumn("place", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["shard", "bucket", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("offset") + F.col("place")).cast("long").alias("slot"), "grown_shard")
