"""Micro-batches over several landed files against the batch answer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F, types as T

from advisorylake.session import remove_path
from advisorylake.streaming import jobs as J
from advisorylake.streaming.levels import Levels

SCHEMA = T.StructType([
    T.StructField("candidate_id", T.LongType()), T.StructField("source_id", T.IntegerType()),
    T.StructField("content_hash", T.StringType()), T.StructField("arrival", T.LongType()),
    T.StructField("seen_at", T.TimestampType())])


def land(spark, path, files=3):
    """Files in landing order; hashes repeat inside and across files."""
    start = dt.datetime(2026, 1, 1)
    for n in range(files):
        rows = [(i % 7, i % 3, f"h{(i * (n + 1)) % 40}", n * 100 + i, start + dt.timedelta(hours=n * 30 + i))
                for i in range(60)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def test_dedup_over_batches_and_restart(spark, tmp_path):
    landing, base = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, landing, 3)
    stream = lambda: J.read_landing(spark, landing, SCHEMA, files_per_batch=1)
    J.stream_mentions(stream(), base)
    land(spark, landing, 2)
    J.stream_mentions(stream(), base)
    everything = spark.read.schema(SCHEMA).parquet(landing)
    want = everything.select("source_id", "content_hash").distinct()
    got = J.read_batches(spark, f"{base}/mentions", SCHEMA).where("batch >= 0")
    assert got.count() == want.count()
    assert got.select("source_id", "content_hash").exceptAll(want).isEmpty()
    # The second landing repeats known mentions, so only the first three batches hold rows.
    assert {r.batch for r in got.select("batch").distinct().collect()} <= {0, 1, 2}


def test_aggregates_and_windows(spark, tmp_path):
    landing = str(tmp_path / "in")
    batch = land(spark, landing, 3)
    J.stream_candidate_aggs(J.read_landing(spark, landing, SCHEMA, files_per_batch=1), str(tmp_path / "a"))
    got = {tuple(r) for r in J.read_candidate_aggs(spark, str(tmp_path / "a")).collect()}
    want = {tuple(r) for r in batch.groupBy("candidate_id").agg(
        F.count("*"), F.count_distinct("source_id"), F.min("seen_at"), F.max("seen_at")).collect()}
    assert got == want
    J.stream_velocity(J.read_landing(spark, landing, SCHEMA, files_per_batch=1), str(tmp_path / "v"),
                      "seen_at", "1 day", lateness="30 days")
    assert {(r.window_start, r.n) for r in J.read_velocity(spark, str(tmp_path / "v")).collect()} == {
        (r.d, r.n) for r in batch.groupBy(F.date_trunc("day", "seen_at").alias("d")).agg(
            F.count("*").alias("n")).collect()}


def test_bounded_dedup(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = land(spark, landing, 2)
    stream = J.dedup_within(J.read_landing(spark, landing, SCHEMA), "seen_at", "90 days")
    (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
     .trigger(availableNow=True).start(out).awaitTermination())
    assert spark.read.parquet(out).count() == batch.select("source_id", "content_hash").distinct().count()


def test_levels_stay_logarithmic(spark, tmp_path):
    levels = Levels(spark, str(tmp_path / "l"), "k INT, n BIGINT", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), fan=2)
    assert levels.read().count() == 0
    for i in range(11):
        levels.write(spark.createDataFrame([(i % 3, 1), (9, 1)], "k int, n bigint"), i)
        assert {r.k: r.n for r in levels.read().collect()} == {9: i + 1, **{k: len(range(k, i + 1, 3)) for k in range(3) if k <= i}}
        assert len(levels.runs()) == bin(i + 1).count("1")
    assert levels.runs() == [(0, 3), (8, 1), (10, 0)]
    levels.write(spark.createDataFrame([(1, 1), (9, 1)], "k int, n bigint"), 10)  # a replay
    assert {r.k: r.n for r in levels.read().collect()}[9] == 11
    remove_path(spark, f"{levels.path}/level=1/batch={8:012d}/_SUCCESS")  # cut off while it was written
    assert levels.runs() == [(0, 3), (8, 0), (9, 0), (10, 0)] and {r.k: r.n for r in levels.read().collect()}[9] == 11
