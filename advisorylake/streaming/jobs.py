"""Structured Streaming jobs over landed mention files.

Two rules hold everywhere. A micro-batch writes into a folder named after its id, so a
replay after a lost executor replaces the same rows instead of adding to them. Watermarks
follow ingest time: an advisory may carry a date years in the past and must still count.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from advisorylake.operators.ingest import mention_dedup
from advisorylake.operators.leads import reconcile_leads
from advisorylake.streaming.levels import Levels


def read_landing(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None],
                mode: str = "append") -> None:
    """Process everything that has landed, then stop. The offset of a batch is committed
    only after ``handle`` returned, so progress never runs ahead of the data."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(handle).start())
    query.awaitTermination()


def _batch_path(base: str, batch_id: int) -> str:
    return f"{base}/batch={batch_id}"


def read_batches(spark: SparkSession, base: str, schema: T.StructType | str) -> DataFrame:
    """All written batches with their ``batch`` number."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
                             ).option("basePath", base).parquet(f"{base}/batch=*")


def stream_mentions(stream: DataFrame, base: str) -> None:
    """Store new mentions, exactly once per (source, hash), then move the cursor.

    ``stream`` carries source_id, content_hash, arrival and seen_at among its columns. The
    check against stored mentions reads their two key columns only. The cursor row of a
    batch is written after its mentions.
    """
    target, cursors = f"{base}/mentions", f"{base}/cursors"
    schema = stream.schema
    # An empty batch gives the first read something to find.
    stream.sparkSession.createDataFrame([], schema).write.mode("ignore").parquet(
        _batch_path(target, -1))

    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = read_batches(batch.sparkSession, target, schema).where(
            F.col("batch") < batch_id)
        new_rows = mention_dedup(batch, stored).select(*schema.names)
        new_rows.write.mode("overwrite").parquet(_batch_path(target, batch_id))
        cursor = batch.groupBy("source_id").agg(F.max("seen_at").alias("cursor"))
        cursor.write.mode("overwrite").parquet(_batch_path(cursors, batch_id))

    run_batches(stream, f"{base}/checkpoint", handle)


def dedup_within(stream: DataFrame, ingest_time: str, horizon: str) -> DataFrame:
    """Bounded variant: repeats inside ``horizon`` of ingest time are dropped and the state
    of older keys is released. Repeats beyond it need :func:`stream_mentions`."""
    return stream.withWatermark(ingest_time, horizon).dropDuplicatesWithinWatermark(
        ["source_id", "content_hash"])


PARTIALS = "candidate_id BIGINT, source_id INT, n BIGINT, lo TIMESTAMP, hi TIMESTAMP"


def stream_candidate_aggs(stream: DataFrame, base: str) -> None:
    """Partial aggregates per (candidate, source) of each batch, compacted in levels.

    The running aggregate is a table, not operator state, so it neither grows in executor
    memory nor has to be rebuilt; readers combine logarithmically many partials.
    """
    levels = partial_levels(stream.sparkSession, base)

    def handle(batch: DataFrame, batch_id: int) -> None:
        levels.write(batch.groupBy("candidate_id", "source_id").agg(
            F.count("*").alias("n"), F.min("seen_at").alias("lo"), F.max("seen_at").alias("hi")), batch_id)

    run_batches(stream, f"{base}/checkpoint", handle)


def partial_levels(spark: SparkSession, base: str) -> Levels:
    return Levels(spark, f"{base}/partials", PARTIALS, lambda rows: rows.groupBy("candidate_id", "source_id").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def read_candidate_aggs(spark: SparkSession, base: str) -> DataFrame:
    return partial_levels(spark, base).read().groupBy("candidate_id").agg(
        F.sum("n").alias("mention_count"), F.count("source_id").alias("source_count"),
        F.min("lo").alias("first_seen_at"), F.max("hi").alias("last_seen_at"))


WINDOWS = "window_start TIMESTAMP, window_end TIMESTAMP, n BIGINT"


def stream_velocity(stream: DataFrame, base: str, ingest_time: str, length: str,
                    slide: str | None = None, lateness: str = "1 day") -> None:
    """Counts per tumbling or sliding window of ingest time, in update mode."""
    span = F.window(ingest_time, length, slide) if slide else F.window(ingest_time, length)
    counts = (stream.withWatermark(ingest_time, lateness).groupBy(span.alias("w"))
              .agg(F.count("*").alias("n"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))

    levels = window_levels(stream.sparkSession, base)
    run_batches(counts, f"{base}/checkpoint", levels.write, mode="update")


def window_levels(spark: SparkSession, base: str) -> Levels:
    """The newest count of each window."""
    return Levels(spark, f"{base}/windows", WINDOWS, lambda rows: rows.groupBy("window_start", "window_end").agg(
        F.max_by("n", "batch").alias("n")))


def read_velocity(spark: SparkSession, base: str) -> DataFrame:
    return window_levels(spark, base).read()


FIRST_SEEN = "candidate_id BIGINT, day TIMESTAMP, lo TIMESTAMP, n BIGINT"


def stream_late_data(stream: DataFrame, base: str, ingest_time: str = "ingested_at") -> None:
    """Earliest event date per candidate and ingest day.

    The watermark releases the state of a past ingest day; an event date of any age still
    lowers the minimum because it arrives in its own ingest day.
    """
    daily = (stream.withWatermark(ingest_time, "1 day")
             .groupBy(F.window(ingest_time, "1 day").alias("w"), "candidate_id")
             .agg(F.min("seen_at").alias("lo"), F.count("*").alias("n"))
             .select("candidate_id", F.col("w.start").alias("day"), "lo", "n"))

    run_batches(daily, f"{base}/checkpoint", day_levels(stream.sparkSession, base).write, mode="update")


def day_levels(spark: SparkSession, base: str) -> Levels:
    """The newest state of each candidate and ingest day."""
    return Levels(spark, f"{base}/first_seen", FIRST_SEEN, lambda rows: rows.groupBy("candidate_id", "day").agg(
        F.min("lo").alias("lo"), F.max_by("n", "batch").alias("n")))


def read_first_seen(spark: SparkSession, base: str) -> DataFrame:
    """First event date of each candidate, and its rows that came before the watermark passed them."""
    return day_levels(spark, base).read().groupBy("candidate_id").agg(
        F.min("lo").alias("first_seen_at"), F.sum("n").alias("n"))


def stream_lead_promotion(nvd: DataFrame, candidates: DataFrame, base: str,
                          as_of: dt.datetime) -> None:
    """Each batch of catalogue rows re-computes the leads of the candidates it touches."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        touched = candidates.join(batch.select(F.col("id").alias("_k")).distinct(),
                                  F.col("cve_id") == F.col("_k"), "left_semi")
        reconcile_leads(touched, batch, as_of).write.mode("overwrite").parquet(
            _batch_path(f"{base}/promoted", batch_id))

    run_batches(nvd, f"{base}/checkpoint", handle)
