"""Report sinks: CSV, JSON lines, a JSON document with its meta data, the triage export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from advisorylake.plans.lists import TRIAGE_COLUMNS


def sink_rows(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write a report; nulls are empty in CSV and absent in JSON. Executors write in
    parallel, so the driver never holds the rows."""
    writer = df.write.mode("error")
    if fmt == "csv":
        writer.option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def sink_document(df: DataFrame, path: str, meta: DataFrame | None = None) -> str:
    """A report as JSON: rows under ``data``, with nulls spelled out, and the one row of
    ``meta`` beside them. Rows are JSON lines, so a report of any size is written in parallel."""
    df.write.mode("error").option("ignoreNullFields", "false").json(f"{path}/data")
    if meta is not None:
        meta.limit(1).write.mode("error").option("ignoreNullFields", "false").json(f"{path}/meta")
    return path


def sink_triage_csv(rows: DataFrame, path: str) -> str:
    """Write the triage columns of ``lists.triage``."""
    return sink_rows(rows.select(*TRIAGE_COLUMNS), path)
