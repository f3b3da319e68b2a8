"""The driver's star-schema tables seen as domain tables.

Each view is one portable SQL text: Spark runs it with DataFrames bound to the ``{name}``
slots, DuckDB gets the same text as a CTE. Nothing is sampled or filtered.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, types as T

from advisorylake.params import UTC, Params
from advisorylake.session import pin_utc

LENS_PARAMS = Params(
    as_of=dt.datetime(2001, 12, 1, tzinfo=UTC),
    op_min_date=dt.datetime(1996, 6, 1, tzinfo=UTC),
    op_year="1996",
    archive_sources=("NATION_0", "NATION_1", "NATION_2"),
)

DRIVER_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
              "o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}

VIEWS = {
    "sources": """
SELECT n_nationkey AS id, n_name AS name, n_regionkey + 1 AS tier,
       CASE n_nationkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'rss' WHEN 2 THEN 'git' ELSE 'scrape' END AS method,
       n_nationkey % 7 <> 0 AS enabled, 3600 * (1 + n_nationkey % 4) AS cadence_seconds,
       CASE WHEN n_nationkey % 6 <> 5 THEN TIMESTAMP '2001-12-01 00:00:00' - INTERVAL '1' HOUR * CAST(n_nationkey % 9 AS INT) END AS last_success_at,
       CASE WHEN n_nationkey % 8 = 3 THEN TIMESTAMP '2001-12-01 00:00:00' - INTERVAL '1' HOUR * CAST(n_nationkey % 5 AS INT) END AS last_error_at
FROM {nation}""",
    "candidates": """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE
         concat('CVE-', CAST(1995 + o_orderkey % 7 AS STRING), '-', lpad(CAST(o_orderkey AS STRING), 7, '0')) END AS cve_id,
       CASE WHEN o_orderkey % 37 = 1 THEN o_orderkey - 1 END AS merged_into,
       CASE WHEN o_orderkey % 37 = 1 THEN 'merged' WHEN o_orderkey % 41 = 0 THEN 'rejected'
            WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'P' THEN 'emerging' ELSE 'candidate' END AS status,
       CASE WHEN o_orderkey % 43 = 0 THEN TRUE WHEN o_orderkey % 2 = 0 THEN FALSE END AS withdrawn,
       CASE WHEN o_orderkey % 29 = 0 THEN TRUE WHEN o_orderkey % 3 = 0 THEN FALSE END AS in_kev,
       CASE WHEN o_orderkey % 13 = 0 THEN TRUE END AS has_public_poc,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'likely-critical' WHEN '2-HIGH' THEN 'likely-high'
            WHEN '3-MEDIUM' THEN 'likely-medium' END AS severity_hint,
       CASE o_orderkey % 6 WHEN 0 THEN 'Remote Code Execution (RCE)' WHEN 1 THEN 'SQL Injection' WHEN 2 THEN 'XSS' WHEN 3 THEN 'memory leak' END AS vuln_type,
       CASE o_orderkey % 4 WHEN 0 THEN 'network' WHEN 1 THEN 'adjacent' WHEN 2 THEN 'local' END AS attack_vector,
       o_orderdate AS first_seen_at,
       o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 90 AS INT) AS last_seen_at,
       o_orderdate + INTERVAL '1' DAY AS created_at
FROM {orders}""",
    "published_cves": """
SELECT cve_id AS id,
       CASE WHEN id % 11 = 0 THEN 'REJECTED' ELSE 'PUBLISHED' END AS state,
       first_seen_at + INTERVAL '1' DAY * CAST(id % 60 AS INT) AS cvelist_published_at,
       CASE WHEN id % 3 = 0 THEN first_seen_at + INTERVAL '1' DAY * CAST(id % 120 - 20 AS INT) END AS nvd_published_at,
       CASE WHEN id % 3 = 0 THEN first_seen_at + INTERVAL '1' DAY * CAST(id % 120 - 20 + id % 45 AS INT) END AS nvd_first_observed_at,
       CASE WHEN id % 9 = 0 THEN first_seen_at + INTERVAL '1' DAY * CAST(id % 120 - 17 + id % 45 AS INT) END AS nvd_first_analyzed_observed_at
FROM {candidates} WHERE cve_id IS NOT NULL AND id % 2 = 0""",
    "mentions": """
SELECT l_orderkey AS candidate_id, s_nationkey AS source_id, l_shipdate AS seen_at,
       concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS content_key
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "affected_products": """
SELECT DISTINCT l_orderkey AS candidate_id, p_brand AS vendor, p_name AS product,
       CASE p_type WHEN 'PROMO' THEN 'malware' WHEN 'ECONOMY' THEN 'distro' WHEN 'SMALL' THEN NULL ELSE 'product' END AS kind,
       CASE p_size % 6 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'go' WHEN 3 THEN 'maven' WHEN 4 THEN 'crates.io' END AS ecosystem
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "cvss_scores": """
SELECT l_orderkey AS candidate_id,
       CASE l_linenumber WHEN 1 THEN '3.1' WHEN 2 THEN '4.0' ELSE '3.0' END AS version,
       CASE WHEN l_returnflag = 'A' THEN 'authoritative' ELSE 'derived' END AS provenance,
       max(CASE WHEN l_linenumber <> 2 OR l_orderkey % 3 <> 0 THEN l_quantity END) / 5.0 AS base_score
FROM {lineitem} WHERE l_linenumber <= 3 AND l_orderkey % 4 <> 0 GROUP BY 1, 2, 3""",
    "epss_scores": """
SELECT concat('CVE-', CAST(1995 + user_id % 7 AS STRING), '-', lpad(CAST(user_id AS STRING), 7, '0')) AS cve_id,
       CAST(ts AS DATE) AS scored_date, max(value) / (max(value) + 100.0) AS score
FROM {events} WHERE user_id % 5 <> 0 GROUP BY 1, 2""",
    "github_repos": """
SELECT concat('owner', CAST(s_nationkey AS STRING), '/', replace(s_name, '#', CASE WHEN s_suppkey % 9 = 0 THEN '-poc-' ELSE '-' END)) AS full_name,
       CASE WHEN s_suppkey % 6 <> 0 THEN CAST(floor(abs(s_acctbal)) AS INT) END AS stars, 10 * CAST(s_suppkey % 4 AS INT) AS priority,
       CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2001-12-01 00:00:00' - INTERVAL '1' HOUR * CAST(s_suppkey % 12 AS INT) END AS last_scanned_at
FROM {supplier}""",
    "identifier_edges": """
SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM {orders} WHERE o_orderkey % 5 <> 4""",
}

_INPUTS = {
    "sources": ["nation"], "candidates": ["orders"], "published_cves": ["candidates"],
    "mentions": ["lineitem", "supplier"], "affected_products": ["lineitem", "part"],
    "cvss_scores": ["lineitem"], "epss_scores": ["events"], "github_repos": ["supplier"],
    "identifier_edges": ["orders"],
}


class Lens:
    """Lazy domain tables over one driver folder; each attribute is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = LENS_PARAMS):
        pin_utc(spark)
        self.spark, self.sf_dir, self.params = spark, sf_dir.rstrip("/"), params

    def driver(self, name: str) -> DataFrame:
        # Declaring TIMESTAMP up front avoids a per-row cast that would hide the column
        # from Parquet filter pushdown.
        return (self.spark.read.schema(T.StructType.fromDDL(DRIVER_SCHEMAS[name]))
                .parquet(f"{self.sf_dir}/{name}.parquet"))

    def view(self, name: str) -> DataFrame:
        inputs = {
            slot: self.view(slot) if slot in VIEWS else self.driver(slot)
            for slot in _INPUTS[name]
        }
        return self.spark.sql(VIEWS[name], **inputs)

    sources = cached_property(lambda self: self.view("sources"))
    candidates = cached_property(lambda self: self.view("candidates"))
    published_cves = cached_property(lambda self: self.view("published_cves"))
    mentions = cached_property(lambda self: self.view("mentions"))
    affected_products = cached_property(lambda self: self.view("affected_products"))
    cvss_scores = cached_property(lambda self: self.view("cvss_scores"))
    epss_scores = cached_property(lambda self: self.view("epss_scores"))
    github_repos = cached_property(lambda self: self.view("github_repos"))
    identifier_edges = cached_property(lambda self: self.view("identifier_edges"))


def duckdb_ctes() -> str:
    """The same views as a WITH prefix for DuckDB (no trailing comma)."""
    parts = []
    for name, text in VIEWS.items():
        body = text.format(**{slot: slot for slot in _INPUTS[name]})
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts)
