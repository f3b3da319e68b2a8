"""Exploit indexes in JSON: one parse of a document."""

from __future__ import annotations

import datetime as dt

from advisorylake.sources.exploited import scan_poc_index_json

RAW = '[{"html_url":"","description":"d","created_at":"20240203T101112Z"},{"html_url":"u","description":"","created_at":"2024-02-03T10:11:11+00:00"}]'


def test_parsed_once(spark):
    docs = spark.createDataFrame([("cve-2024-0001.json", RAW), ("none.json", RAW), ("cve-2024-0002.json", "[]"), ("cve-2024-0003.json", "?"),
                                  ("cve-2024-0004.json", None)], "file_name string, raw string")
    found = scan_poc_index_json(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    rows = [(r.cve_id, r.url, r.snippet, r.seen_at) for r in found.collect()]
    assert rows == [("CVE-2024-0001", "u", "d", dt.datetime(2024, 2, 3, 10, 11, 11))]
