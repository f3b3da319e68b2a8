"""Spark result against DuckDB result, as sorted rows; also a command-line check."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(df, con, sql: str) -> str | None:
    rows = [tuple(r) for r in df.collect()]
    got = table(df.columns, rows)
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"first difference:\n  spark {str(a)[:600]}\n  duck  {str(b)[:600]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from advisorylake.session import build_session

    sf_dir = sys.argv[1]
    wanted = set(sys.argv[2:])
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8",
                                         "spark.ui.enabled": "false",
                                         "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if problem is None else "DIFF " + problem
            else:
                state = f"rows-only {len(df.collect())}"
        except Exception as exc:  # noqa: BLE001 - report and go on
            state = "ERROR " + str(exc)[:900]
        bad += state.startswith(("DIFF", "ERROR"))
        empty = ""
        if state == "ok" and df.isEmpty():
            empty = " (EMPTY)"
        print(f"{name:32s} {time.time() - start:6.2f}s {state}{empty}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
