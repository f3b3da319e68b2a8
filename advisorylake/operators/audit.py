"""Data-quality checks over the domain tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from advisorylake import schemas as S
from advisorylake.functions.health import age_seconds, coarse_error, source_state, stale_after


def _outside(column: str, domain: list[str]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(domain)


def _not_between(column: str, low: float, high: float) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).between(low, high)


#: (table, rule, column): what is allowed, a list of values or the two ends of a range. Nulls break no rule.
CONSTRAINTS: list[tuple[str, str, str, list[str] | tuple[float, float]]] = [
    ("published_cves", "state_domain", "state", S.CVE_STATES),
    ("sources", "method_domain", "method", S.SOURCE_METHODS),
    ("sources", "tier_range", "tier", (1, 5)),
    ("candidates", "status_domain", "status", S.CANDIDATE_STATUSES),
    ("candidates", "attack_vector_domain", "attack_vector", S.ATTACK_VECTORS),
    ("candidates", "severity_hint_domain", "severity_hint", S.SEVERITY_HINTS),
    ("candidates", "enrichment_confidence_range", "enrichment_confidence", (0, 1)),
    ("candidate_links", "method_domain", "method", S.LINK_METHODS),
    ("candidate_links", "status_domain", "status", S.LINK_STATUSES),
    ("candidate_links", "confidence_range", "confidence", (0, 1)),
    ("cvss_scores", "provenance_domain", "provenance", S.PROVENANCES),
    ("cvss_scores", "score_range", "base_score", (0, 10)),
    ("cvss_scores", "version_domain", "version", S.CVSS_VERSIONS),
    ("cvss_scores", "severity_domain", "base_severity", S.CVSS_SEVERITIES),
    ("cvss_scores", "confidence_range", "confidence", (0, 1)),
    ("epss_scores", "score_range", "score", (0, 1)),
    ("epss_scores", "percentile_range", "percentile", (0, 1)),
    ("affected_products", "status_domain", "default_status", S.AFFECTED_STATUSES),
    ("affected_products", "normalization_domain", "normalization_method", S.NORMALIZATION_METHODS),
    ("affected_products", "normalization_confidence_range", "normalization_confidence", (0, 1)),
    ("affected_products", "confidence_range", "confidence", (0, 1)),
    ("product_aliases", "source_domain", "source", S.ALIAS_SOURCES),
    ("product_aliases", "confidence_range", "confidence", (0, 1)),
]


def constraint_rules(table: str, columns: list[str]) -> list[tuple[str, Column]]:
    """Name and violation of each rule on the columns at hand; missing columns are for :func:`audit_schema`."""
    found = [(rule, _outside(c, allowed) if isinstance(allowed, list) else _not_between(c, *allowed))
             for t, rule, c, allowed in CONSTRAINTS if t == table and c in columns]
    if table == "candidate_links" and {"a", "b"} <= set(columns):
        found.append(("ordered_pair", F.col("a") >= F.col("b")))
    return found


def audit_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, violations): one counting pass per table."""
    out = None
    for name, df in tables.items():
        rules = constraint_rules(name, df.columns)
        if not rules:
            continue
        row = df.agg(*[F.count_if(cond).alias(rule) for rule, cond in rules])
        part = row.select(F.lit(name).alias("table_name"), F.inline(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations"))
            for rule, _ in rules])))
        out = part if out is None else out.unionByName(part)
    return out


def audit_uniqueness(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, duplicate_keys); grouping treats nulls as equal."""
    out = None
    for name, (df, key) in tables.items():
        part = (df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
                .agg(F.count("*").alias("duplicate_keys"))
                .select(F.lit(name).alias("table_name"), "duplicate_keys"))
        out = part if out is None else out.unionByName(part)
    return out


def audit_references(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(link, orphans): rows whose non-null reference has no target."""
    out = None
    for label, child, column, parent, key in links:
        refs = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("ref")).agg(
            F.count("*").alias("n"))
        targets = parent.select(F.col(key).alias("ref")).distinct()
        part = refs.join(targets, "ref", "left_anti").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
            F.lit(label).alias("link"), "orphans")
        out = part if out is None else out.unionByName(part)
    return out


def missing_columns(table: str, actual: T.StructType) -> list[str]:
    """Declared columns the actual schema lacks."""
    return sorted(set(S.TABLES[table].names) - set(actual.names))


def audit_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, missing, rows): declared columns absent from each table, and how many
    rows that concerns."""
    out = None
    for name, df in tables.items():
        missing = ",".join(missing_columns(name, df.schema))
        part = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(missing).alias("missing"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def source_rows(sources: DataFrame, as_of: dt.datetime, active: list[str] = (),
                queued: list[str] = ()) -> DataFrame:
    error = F.col("last_error") if "last_error" in sources.columns else F.lit(None).cast("string")
    return sources.select(
        "name", "method", "tier", "enabled",
        source_state(as_of, name=F.col("name"), enabled=F.col("enabled"),
                     cadence=F.col("cadence_seconds"), last_success=F.col("last_success_at"),
                     last_error=F.col("last_error_at"), active=active,
                     queued=queued).alias("state"),
        age_seconds(F.col("last_success_at"), as_of).alias("success_age_seconds"),
        stale_after(F.col("cadence_seconds")).alias("stale_after_seconds"),
        F.coalesce(error != "", F.lit(False)).alias("has_error"),
        coarse_error(error).alias("error_class"))


STATES = ["ok", "active", "queued", "error", "stale", "never", "disabled"]


def source_health(sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    """(item, n): totals, one row per state, and a warning row per bad state present."""
    states = source_rows(sources, as_of)
    row = states.agg(F.count("*").alias("total"), F.count_if(F.col("enabled")).alias("enabled"),
                     *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    names = ["total", "enabled", *STATES]
    counts = row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("item"), F.col(n).alias("n")) for n in names])))
    alerts = counts.where(F.col("item").isin("error", "stale", "never") & (F.col("n") > 0))
    return counts.unionByName(alerts.select(
        F.concat(F.lit("alert:sources_"), F.col("item")).alias("item"), "n"))


def cursor_ages(state: DataFrame, as_of: dt.datetime) -> DataFrame:
    return (state.where(~F.col("id").startswith("runtime:"))
            .select("id", "cursor", "updated_at",
                    age_seconds(F.col("updated_at"), as_of).alias("age_seconds")).orderBy("id"))


def ingestion_status(facts: DataFrame, mentions: DataFrame, affected: DataFrame,
                     published: DataFrame, op_min_date: dt.datetime, op_year: str) -> DataFrame:
    """(item, n) counters; the candidate counters share one pass over the facts."""
    from advisorylake.functions.dates import ts
    from advisorylake.operators.predicates import cve_year

    old = F.coalesce(cve_year(F.col("cve_id")) < op_year, F.lit(False))
    early = F.col("first_seen_at").isNull() | (F.col("first_seen_at") < ts(op_min_date))
    base = F.col("pending_base")
    parts = [
        facts.agg(F.count_if(F.col("merged_into").isNull()).alias("candidates"),
                  F.count_if("pending").alias("pending_operational"),
                  F.count_if(base & early & ~old).alias("historical_pending"),
                  F.count_if(base & old).alias("source_inconsistencies"),
                  F.count_if(base & (early | old)).alias("historical_inconsistencies")),
        mentions.agg(F.count("*").alias("mentions")),
        affected.agg(F.count("*").alias("affected_products")),
        published.agg(F.count("*").alias("published_cves"),
                      F.count("nvd_published_at").alias("nvd_published"),
                      F.count_if(F.col("state") == "REJECTED").alias("rejected_cves")),
    ]
    out = None
    for part in parts:
        long = part.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in part.columns])))
        out = long if out is None else out.unionByName(long)
    return out


def repo_scan_status(repos: DataFrame) -> DataFrame:
    return repos.agg(
        F.count("*").alias("total"),
        F.count("last_scanned_at").alias("commits_scanned"),
        F.count_if(F.col("last_scanned_at").isNull()).alias("commits_pending"),
        F.count("adv_last_scanned_at").alias("advisories_scanned"),
        F.count_if(F.col("adv_last_scanned_at").isNull()).alias("advisories_pending"))
