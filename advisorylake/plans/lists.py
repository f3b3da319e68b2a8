"""Ranked and paged lists: emerging, critical, software, candidate detail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.functions.dates import period_bounds, period_label, ts, window_start
from advisorylake.operators.aggregates import (
    cvss_selected, epss_current, first_product, max_cvss, min_tier, source_names, timeline_last,
)
from advisorylake.operators.predicates import (
    distinct_ids, kev_filter, matching_products, mentioned_by, operational_candidate,
    with_product, with_source,
)
from advisorylake.params import Params
from advisorylake.plans.reports import check_maturity
from advisorylake.session import cut_lineage

# Columns of the triage export, and the size at which a caller may cut it.
TRIAGE_COLUMNS = ["cve_id", "maturity", "in_kev", "cvss", "severity_hint", "vuln_type",
                  "days_ahead_vs_nvd_present", "source_count", "mention_count", "sources",
                  "first_seen_at", "last_seen_at"]
TRIAGE_LIMIT = 5000
# Points of the criticality score.
KEV_POINTS, POC_POINTS, CVSS_FACTOR = 50, 20, 4.0
HINT_POINTS = {"critical": 40, "high": 28, "medium": 14, "low": 4}
TIER_POINTS = {1: 15, 2: 10, 3: 6, 4: 3}


def emerging_rows(facts: DataFrame, affected: DataFrame, mentions: DataFrame,
                  sources: DataFrame, p: Params, *, since_days: int | None = None,
                  source: str | None = None, tier: int | None = None, kind: str | None = None,
                  in_kev: bool | None = None, tech: str | None = None,
                  pending_only: bool = False, maturity: str | None = None,
                  period: str | None = None, granularity: str = "month",
                  include_historical: bool = False) -> DataFrame:
    check_maturity(maturity)
    rows = facts.where(F.col("merged_into").isNull())
    if not include_historical:
        rows = rows.where(operational_candidate(p))
    if maturity is not None:
        rows = rows.where(F.col("maturity") == maturity)
    if since_days is not None:
        rows = rows.where(F.col("last_seen_at") >= ts(p.as_of - dt.timedelta(days=since_days)))
    if period:
        start, end = period_bounds(period, granularity)
        rows = rows.where((F.col("first_seen_at") >= ts(start)) & (F.col("first_seen_at") < ts(end)))
    if in_kev is not None:
        rows = kev_filter(rows, in_kev)
    if pending_only:
        rows = rows.where("pending")
    rows = with_source(rows, mentions, sources, source, tier)
    return with_product(rows, affected, kind, tech)


def attach_details(page: DataFrame, cvss: DataFrame, mentions: DataFrame,
                   sources: DataFrame) -> DataFrame:
    """Best CVSS and source names for the rows of one page.

    The big tables are cut to the page's ids before they are grouped. The ids carry no hint:
    Spark broadcasts them when the page is small.
    """
    ids = page.select(F.col("id").alias("candidate_id"))
    scores = max_cvss(cvss.join(ids, "candidate_id", "left_semi")).withColumnRenamed(
        "candidate_id", "cvss_id")
    names = source_names(mentions.join(ids, "candidate_id", "left_semi"),
                         sources).withColumnRenamed("candidate_id", "names_id")
    return (page.join(scores, F.col("id") == F.col("cvss_id"), "left")
            .join(names, F.col("id") == F.col("names_id"), "left").drop("cvss_id", "names_id"))


def emerging_list(rows: DataFrame, cvss: DataFrame, mentions: DataFrame, sources: DataFrame,
                  page: int = 1, page_size: int = 50) -> DataFrame:
    order = [F.desc("last_seen_at"), F.asc("id")]
    offset = (max(1, page) - 1) * page_size
    # Written once: the page is read for its rows and twice for its ids.
    one_page = cut_lineage(rows.orderBy(*order).offset(offset).limit(page_size))
    return attach_details(one_page, cvss, mentions, sources).orderBy(*order)


def emerging_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def emerging_list_cli(candidates: DataFrame, cvss: DataFrame, mentions: DataFrame,
                      sources: DataFrame, *, since: dt.datetime | None = None,
                      source: str | None = None, tier: int | None = None,
                      min_mentions: int = 1, limit: int = 50) -> DataFrame:
    """Expects ``mention_count``, ``source_count`` and the present lead on candidates."""
    rows = candidates.where(F.col("merged_into").isNull()
                            & (F.col("mention_count") >= min_mentions))
    if since is not None:
        rows = rows.where(F.col("last_seen_at") >= ts(since))
    rows = with_source(rows, mentions, sources, source, tier)
    page = rows.orderBy(F.desc("last_seen_at"), "id").limit(limit)
    ids = page.select(F.col("id").alias("candidate_id"))
    best = (cvss.where(F.col("base_score").isNotNull()).join(ids, "candidate_id", "left_semi")
            .groupBy(F.col("candidate_id").alias("best_id"))
            .agg(F.max(F.struct("base_score", "version")).alias("best")))
    text = F.concat(F.col("best.base_score").cast("string"), F.lit(" (v"),
                    F.col("best.version"), F.lit(")"))
    return (page.join(best, F.col("id") == F.col("best_id"), "left").select(
        "id", F.coalesce("cve_id", F.substring(F.col("id").cast("string"), 1, 8)).alias("cve_id"),
        "status", F.col("vuln_type").alias("vuln"),
        F.coalesce(text, F.when(F.col("severity_hint") != "", F.col("severity_hint"))).alias("sev"),
        F.col("mention_count").alias("mentions"), F.col("source_count").alias("sources"),
        F.col("days_ahead_vs_nvd_present").alias("days_ahead"),
        F.date_format("last_seen_at", "yyyy-MM-dd HH:mm").alias("last_seen"))
        .orderBy(F.desc("last_seen"), "id"))


def triage(rows: DataFrame, cvss: DataFrame, mentions: DataFrame, sources: DataFrame,
           limit: int | None = None) -> DataFrame:
    """Fixed columns of the export, newest first; whole unless the caller gives a limit.

    ``rows`` has mention_count, source_count and the present lead.
    """
    order = [F.desc("last_seen_at"), F.asc("id")]
    page = rows if limit is None else rows.orderBy(*order).limit(limit)
    return attach_details(page, cvss, mentions, sources).orderBy(*order).select(*TRIAGE_COLUMNS)


def _points(table: dict, key: Column, otherwise: int) -> Column:
    out = None
    for value, points in table.items():
        out = F.when(key == value, points) if out is None else out.when(key == value, points)
    return out.otherwise(otherwise)


def criticality_score(normalize_hint: bool = False) -> Column:
    """KEV, exploit, severity and source-tier points.

    Stored hints read ``likely-high`` while the table says ``high``, so a hint adds
    nothing unless ``normalize_hint`` strips the prefix.
    """
    hint = F.lower(F.col("severity_hint"))
    if normalize_hint:
        hint = F.regexp_replace(hint, "^likely-", "")
    severity = F.coalesce(F.col("cvss") * CVSS_FACTOR, _points(HINT_POINTS, hint, 0).cast("double"))
    return F.round(
        F.when(F.col("in_kev"), KEV_POINTS).otherwise(0)
        + F.when(F.col("has_public_poc"), POC_POINTS).otherwise(0)
        + severity + _points(TIER_POINTS, F.col("min_tier"), 1), 1)


def signal_ids(candidates: DataFrame, cvss: DataFrame) -> DataFrame:
    """Distinct ids that carry a severity or exploitation signal."""
    live = candidates.where(F.col("merged_into").isNull() & (
        F.col("in_kev") | F.col("has_public_poc") | F.col("severity_hint").isNotNull()))
    scored = cvss.where(F.col("base_score").isNotNull()).select(F.col("candidate_id").alias("id"))
    return live.select("id").union(scored).distinct()


def pending_critical(facts: DataFrame, cvss: DataFrame, mentions: DataFrame,
                     sources: DataFrame, affected: DataFrame, top: int = 50,
                     maturity: str = "all", kind: str | None = None, tech: str | None = None,
                     normalize_hint: bool = False) -> DataFrame:
    """Top pending candidates by criticality, with the parts of the score.

    The score row set also answers "has a CVSS row", which replaces the distinct union of
    signal ids. The product name is looked up for the final rows only.
    """
    check_maturity(maturity)
    pend = facts.where("pending")
    if maturity != "all":
        pend = pend.where(F.col("maturity") == maturity)
    pend = with_product(pend, affected, kind, tech)
    scores = cvss.where(F.col("base_score").isNotNull()).groupBy(
        F.col("candidate_id").alias("cvss_id")).agg(F.max("base_score").alias("cvss"))
    tiers = min_tier(mentions, sources).withColumnRenamed("candidate_id", "tier_id")
    signalled = (
        pend.join(scores, F.col("id") == F.col("cvss_id"), "left")
        .where(F.col("in_kev") | F.col("has_public_poc") | F.col("severity_hint").isNotNull()
               | F.col("cvss_id").isNotNull())
        .join(tiers, F.col("id") == F.col("tier_id"), "left")
        .withColumn("score", criticality_score(normalize_hint))
    )
    order = [F.desc("score"), F.desc_nulls_last("first_seen_at"), F.asc("id")]
    best = cut_lineage(signalled.orderBy(*order).limit(top))
    ids = best.select(F.col("id").alias("candidate_id"))
    names = first_product(affected.join(ids, "candidate_id", "left_semi")).withColumnRenamed(
        "candidate_id", "product_id")
    lead = ["days_ahead_vs_nvd_present"] if "days_ahead_vs_nvd_present" in facts.columns else []
    return (best.join(names, F.col("id") == F.col("product_id"), "left")
            .select("id", "cve_id", "product", "maturity", "score", "in_kev", "has_public_poc",
                    "cvss", "severity_hint", "vuln_type", "min_tier", "first_seen_at", *lead)
            .orderBy(*order))


def software_rows(facts: DataFrame, affected: DataFrame, p: Params, name: str,
                  ecosystem: str | None = None, granularity: str = "month", months: int = 24,
                  include_historical: bool = False) -> DataFrame:
    """Distinct candidates of one product (exact, any case) in the window."""
    hits = distinct_ids(matching_products(affected, tech=name, ecosystem=ecosystem, exact=True))
    rows = facts.where(F.col("merged_into").isNull() & (
        F.col("first_seen_at") >= ts(window_start(p.as_of, granularity, months))))
    if not include_historical:
        rows = rows.where(operational_candidate(p))
    return rows.join(hits, F.col("id") == F.col("candidate_id"), "left_semi")


def software_series(rows: DataFrame, granularity: str = "month") -> DataFrame:
    return (rows.groupBy(period_label(F.col("first_seen_at"), granularity).alias("period"))
            .agg(F.count("*").alias("identified"), F.count_if(F.col("pending")).alias("pending"))
            .orderBy("period"))


def software_candidates(rows: DataFrame, limit: int = 200) -> DataFrame:
    return (rows.select("id", "cve_id", "in_kev", "pending", "first_seen_at")
            .orderBy(F.desc_nulls_last("first_seen_at"), "id").limit(limit))


def radar_view(candidates: DataFrame, cvss: DataFrame, epss: DataFrame) -> DataFrame:
    """Live candidates with their best score and current EPSS."""
    best = cvss_selected(cvss).select(
        F.col("candidate_id").alias("cvss_key"), F.col("version").alias("cvss_version"),
        F.col("base_score").alias("cvss_score"), F.col("provenance").alias("cvss_provenance"))
    current = epss_current(epss).select(F.col("cve_id").alias("epss_key"),
                                        F.col("score").alias("epss_score"))
    from advisorylake.operators.predicates import spread_nulls

    live = candidates.where(F.col("merged_into").isNull()
                            & F.col("status").isin("candidate", "emerging", "published"))
    return (live.join(best, F.col("id") == F.col("cvss_key"), "left")
            .join(current, spread_nulls(F.col("cve_id"), F.col("id")) == F.col("epss_key"), "left")
            .drop("cvss_key", "epss_key"))


def exploit_before_cve(candidates: DataFrame, mentions: DataFrame, sources: DataFrame,
                       published: DataFrame, tool_sources: list[str]) -> DataFrame:
    """Seen by an exploit-tool source, not known exploited, CVE not published."""
    from advisorylake.operators.predicates import spread_nulls

    seen = mentioned_by(mentions, sources.where(F.col("name").isin(tool_sources)))
    out = published.where(F.col("state") == "PUBLISHED").select(F.col("id").alias("key"))
    return (candidates.where(F.col("merged_into").isNull()
                             & ~F.coalesce(F.col("in_kev"), F.lit(False)))
            .join(seen, F.col("id") == F.col("candidate_id"), "left_semi")
            .join(out, spread_nulls(F.col("cve_id"), F.col("id")) == F.col("key"), "left_anti")
            .orderBy(F.desc("first_seen_at"), "id"))


def multi_signal_cross(leads: DataFrame, affected: DataFrame, cvss: DataFrame,
                       mentions: DataFrame, sources: DataFrame, products: list[str],
                       tool_sources: list[str], min_score: float = 8.0) -> DataFrame:
    """My stack x severe or exploited x exploit sources, by lead.

    One row per (candidate, affected row, mention source) pair as the joins state it.
    """
    best = cvss_selected(cvss).select(F.col("candidate_id").alias("cvss_key"), "base_score")
    mine = affected.where(F.col("product").isin(products)).select(
        F.col("candidate_id").alias("product_key"), "product")
    tools = sources.where(F.col("name").isin(tool_sources)).select(F.col("id").alias("source_id"))
    hits = (mentions.join(tools, "source_id", "left_semi")
            .groupBy("candidate_id").agg(F.count("*").alias("tool_mentions")))
    rows = (leads.where(F.col("merged_into").isNull())
            .join(mine, F.col("id") == F.col("product_key"))
            .join(best, F.col("id") == F.col("cvss_key"), "left")
            .where((F.col("base_score") >= min_score) | F.col("in_kev"))
            .join(hits, F.col("id") == F.col("candidate_id")))
    return rows.select("id", "cve_id", "first_seen_at", "days_ahead_vs_nvd_present",
                       "base_score", "in_kev", "product", "tool_mentions").orderBy(
        F.desc_nulls_last("days_ahead_vs_nvd_present"), "id", "product")


def pre_published_universe(identifiers: DataFrame, candidates: DataFrame,
                           published: DataFrame) -> DataFrame:
    """How many declared CVE ids of unmerged candidates NVD has dated."""
    live = candidates.where(F.col("status") != "merged").select(F.col("id").alias("live_id"))
    cves = (identifiers.where(F.col("scheme") == "CVE")
            .join(live, F.col("candidate_id") == F.col("live_id"), "left_semi")
            .select(F.col("value").alias("cve")).distinct())
    dates = published.select(F.col("id").alias("key"), "nvd_published_at")
    return cves.join(dates, F.col("cve") == F.col("key"), "left").agg(
        F.count_if(F.col("nvd_published_at").isNull()).alias("pre_published"),
        F.count_if(F.col("nvd_published_at").isNotNull()).alias("published"))


def candidate_detail(key: str, *, candidates: DataFrame, identifiers: DataFrame,
                     cvss: DataFrame, affected: DataFrame, mentions: DataFrame,
                     sources: DataFrame, epss: DataFrame, p: Params,
                     include_historical: bool = False) -> dict[str, DataFrame]:
    """Frames about one candidate, each filtered to it at the scan.

    A CVE key finds the oldest live candidate; an id key also reaches tombstones.
    """
    scope = F.lit(True) if include_historical else operational_candidate(p)
    by_cve = (candidates.where((F.col("cve_id") == str(key).upper()) & F.col("merged_into").isNull()
                               & scope).orderBy("first_seen_at", "id").limit(1)
              .select(F.col("id").cast("string")).scalar())
    wanted = F.coalesce(by_cve, F.lit(str(key)))
    mine = candidates.where((F.col("id").cast("string") == wanted) & scope)
    same = F.col("candidate_id").cast("string") == wanted
    order = [c for c in ("id", "content_key") if c in mentions.columns]
    dim = sources.select(F.col("id").alias("sid"), F.col("name").alias("source"))
    timeline = timeline_last(mentions.where(same), 500, order).join(
        dim, F.col("source_id") == F.col("sid")).drop("sid").orderBy("position")
    one_cve = mine.select("cve_id").limit(1)
    return {
        "candidate": mine,
        "identifiers": identifiers.where(same).select("scheme", "value").orderBy("scheme", "value"),
        "cvss": cvss.where(same).orderBy("provenance", "version"),
        "affected": affected.where(same),
        "epss": epss_current(epss.join(F.broadcast(one_cve), "cve_id", "left_semi")),
        "timeline": timeline,
    }
