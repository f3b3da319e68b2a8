"""Advisory records: dates are read once, and filters parse only what they need."""

from __future__ import annotations

from pyspark.sql import functions as F

from advisorylake.functions.dates import parse_advisory_date, parse_iso
from advisorylake.sources.osv import parse_osv
from workloads import scans

DATES = {
    "2024-02-03T10:11:12Z": "2024-02-03 10:11:12", "2024-02-03 10:11:12,5+02:00": "2024-02-03 08:11:12.5", "2024-02-03T10:11": "2024-02-03 10:11:00",
    "20240203T101112Z": "2024-02-03 10:11:12", "20240203": "2024-02-03 00:00:00", "2024-02-03T10Z": None, "2024": "2024-01-01 00:00:00",
    "2024-02-03T1011+0100": None, "2024-02-03T101112+01:00": "2024-02-03 09:11:12", "0001-01-01T00:00:00Z": "0001-01-01 00:00:00", "2024-13-03T10:11:12Z": None,
    "2024-02-03T10:11:12 ": None, "03.02.2024": None, "": None, None: None}


def test_dates(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "s string")
    got = rows.select("s", parse_iso(F.col("s")).cast("string").alias("d"), parse_advisory_date(F.col("s")).cast("string").alias("a")).collect()
    assert {r.s: r.d for r in got} == DATES
    assert {r.s: r.a for r in got} == {k: v and (v if v > "1990" else None) for k, v in DATES.items()}


def test_each_date_is_rewritten_once(spark):
    plan = parse_osv(spark.createDataFrame([("{}",)], "raw string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 8  # four steps for each of two dates


def test_named_fields_are_those_of_the_whole_record(spark):
    raw = ['{"id":"A","aliases":"no list","published":"2024-01-02","modified":"0001-01-01","severity":3}', "{", None, '{"id":"B","modified":"2024-01-03"}']
    docs = spark.createDataFrame([(r,) for r in raw], "raw string")
    names = ["id", "modified_at", "seen"]
    some = parse_osv(docs, ["id"])
    assert set(some.columns) == {"id", "published", "modified", "modified_at", "seen"}
    assert sorted(map(str, some.select(names).collect())) == sorted(map(str, parse_osv(docs).select(names).collect()))


def test_cursor_filters_share_a_parse(spark, sf_dir, monkeypatch):
    calls = []
    real = scans.OSV.parse_osv
    monkeypatch.setattr(scans.OSV, "parse_osv", lambda *a, **k: calls.append(1) or real(*a, **k))
    scans.reg.queries["osv_cursor_filter"](spark, sf_dir)
    assert len(calls) == 1
