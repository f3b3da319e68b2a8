"""Streaming jobs run to completion over the driver tables; the SQL twin is the batch
answer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from advisorylake.functions.hashing import content_hash
from advisorylake.lens import DRIVER_SCHEMAS, VIEWS
from advisorylake.operators.leads import LEADS
from advisorylake.session import scratch_path
from advisorylake.sources.baseline import cursor_overlap
from advisorylake.streaming import jobs as J
from workloads.common import Ctx, F, P, Registry
from workloads.ingestion import _lead_input

reg = Registry()
add = reg.add


def _landing(c: Ctx, table: str):
    return J.read_landing(c.spark, c.sf_dir, T.StructType.fromDDL(DRIVER_SCHEMAS[table]),
                          glob=f"{table}.parquet")


def _landed(c: Ctx, table: str, order: str, parts: int = 5):
    """A table landed part by part in the order of ``order``, each part as the files that its tasks write.

    Yields the stream after every part, which makes one micro-batch of it; a stream that is started again goes on from its checkpoint.
    """
    path = scratch_path(c.spark, f"landed-{table}")
    rows = c.driver(table)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    share = F.floor(parts * (F.col(order) - low) / (high - low + 1))
    for part in range(parts):
        rows.where(share == part).write.mode("append").parquet(path)
        yield J.read_landing(c.spark, path, T.StructType.fromDDL(DRIVER_SCHEMAS[table]), glob="*.parquet")


def _mention_stream(c: Ctx, landing=None):
    """lineitem rows as mentions; every part is repeated under several orders."""
    rows = c.spark.sql(VIEWS["mentions"], lineitem=_landing(c, "lineitem") if landing is None else landing,
                       supplier=c.driver("supplier"))
    title = F.regexp_extract("content_key", r"-(\d+)-\d+-\d+$", 1)
    none = F.lit(None).cast("string")
    return rows.select(
        "candidate_id", "source_id", "seen_at", F.hash("content_key").cast("long").alias("arrival"),
        content_hash(cve=none, native=none, title=title, snippet=none, url=none).alias("content_hash"))


def _mentions(c: Ctx):
    base = scratch_path(c.spark, "stream-mentions")
    stream = _mention_stream(c)
    J.stream_mentions(stream, base)
    return J.read_batches(c.spark, f"{base}/mentions", stream.schema)


_HASH = "sha256(chr(31) || chr(31) || CAST(l_partkey AS STRING) || chr(31) || chr(31))"
_MENTION = f"(SELECT s_nationkey AS source_id, {_HASH} AS content_hash, l_shipdate AS seen_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
add("stream_mentions",
    lambda c: _mentions(c).groupBy("source_id").agg(F.count("*").alias("n")),
    f"SELECT source_id, count(DISTINCT content_hash) AS n FROM {_MENTION} GROUP BY 1")
add("stream_dedup", lambda c: _mentions(c).select("source_id", "content_hash"),
    f"SELECT DISTINCT source_id, content_hash FROM {_MENTION}")


def _cursors(c: Ctx):
    base = scratch_path(c.spark, "stream-cursors")
    J.stream_mentions(_mention_stream(c), base)
    rows = J.read_batches(c.spark, f"{base}/cursors",
                          T.StructType.fromDDL("source_id INT, cursor TIMESTAMP"))
    return rows.groupBy("source_id").agg(F.max("cursor").alias("cursor"))


add("stream_cursors", _cursors,
    f"SELECT source_id, max(seen_at) AS cursor FROM {_MENTION} GROUP BY 1")


def _aggs(c: Ctx):
    base = scratch_path(c.spark, "stream-aggs")
    for landing in _landed(c, "lineitem", "l_orderkey"):
        J.stream_candidate_aggs(_mention_stream(c, landing), base)
    return J.read_candidate_aggs(c.spark, base)


add("stream_candidate_aggs", _aggs,
    "SELECT candidate_id, CAST(count(*) AS BIGINT) AS mention_count, count(DISTINCT source_id) AS source_count, "
    "min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM mentions GROUP BY 1")


def _velocity(c: Ctx, length: str, slide: str | None):
    base = scratch_path(c.spark, "stream-velocity")
    for landing in _landed(c, "events", "event_id"):
        J.stream_velocity(landing, base, "ts", length, slide)
    return J.read_velocity(c.spark, base)


add("stream_velocity_tumbling", lambda c: _velocity(c, "1 day", None),
    "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_velocity_sliding", lambda c: _velocity(c, "24 hours", "1 hour"),
    "SELECT s AS window_start, s + INTERVAL 24 HOUR AS window_end, count(*) AS n FROM (SELECT unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOUR, "
    "date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM events) GROUP BY 1, 2")


def _late(c: Ctx):
    base = scratch_path(c.spark, "stream-late")
    for landing in _landed(c, "events", "event_id"):
        J.stream_late_data(landing.select(
            F.col("user_id").alias("candidate_id"), F.col("ts").alias("ingested_at"),
            (F.col("ts") - F.make_dt_interval((F.col("event_id") % 1000).cast("int"))).alias("seen_at")), base)
    return J.read_first_seen(c.spark, base)


add("stream_late_data", _late,
    "SELECT user_id AS candidate_id, min(ts - INTERVAL 1 DAY * CAST(event_id % 1000 AS INT)) AS first_seen_at, count(*) AS n FROM events GROUP BY 1")
add("stream_cursor_overlap",
    lambda c: cursor_overlap(c.candidates, "last_seen_at", dt.datetime(1998, 3, 1, tzinfo=dt.timezone.utc), dt.timedelta(days=1)).select("id"),
    "SELECT id FROM candidates WHERE last_seen_at >= TIMESTAMP '1998-02-28'")


def _promotion(c: Ctx):
    base = scratch_path(c.spark, "stream-promotion")
    candidates = c.spark.sql(VIEWS["candidates"], orders=_landing(c, "orders"))
    nvd = c.spark.sql(VIEWS["published_cves"], candidates=candidates).where("nvd_published_at IS NOT NULL")
    J.stream_lead_promotion(nvd, _lead_input(c), base, P.as_of)
    schema = T.StructType.fromDDL("id BIGINT, cve_id STRING, old_status STRING, status STRING, promoted_at TIMESTAMP, "
                                  + ", ".join(f"{n} INT" for n in LEADS))
    return J.read_batches(c.spark, f"{base}/promoted", schema).select("id", "old_status", "status", *LEADS)


add("stream_lead_promotion", _promotion,
    "SELECT l.id, l.status AS old_status, 'published' AS status, l.days_ahead_vs_nvd_published, l.days_ahead_vs_nvd_present, l.days_ahead_vs_nvd_analyzed "
    "FROM leads l JOIN published_cves p ON p.id = l.cve_id WHERE p.nvd_published_at IS NOT NULL AND l.merged_into IS NULL "
    "AND l.status IN ('candidate', 'emerging', 'published') AND (l.id % 3 = 0 OR l.days_ahead_vs_nvd_present IS NULL OR l.status <> 'published') "
    "AND (l.status <> 'published' OR (l.id % 3 = 0 AND coalesce(l.days_ahead_vs_nvd_published, l.days_ahead_vs_nvd_present, l.days_ahead_vs_nvd_analyzed) IS NOT NULL))")
