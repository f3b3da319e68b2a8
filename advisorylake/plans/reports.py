"""Pending, trend, lag, queue, funnel and source reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.functions.dates import age_days, period_bounds, period_label, ts, window_start
from advisorylake.operators.predicates import (
    candidate_sources, exclude_backfill, matching_products, operational_candidate,
    operational_published, with_product, with_source,
)
from advisorylake.params import Params
from advisorylake.schemas import MATURITIES

NO_ECOSYSTEM = "(sin ecosistema)"

# Histogram bins as (label, lowest, highest), open ends None.
PRESENT_BINS = [("0-1", None, 1), ("2-7", 2, 7), ("8-14", 8, 14), ("15-30", 15, 30),
                ("31-60", 31, 60), ("61-90", 61, 90), (">90", 91, None)]
PUBLISHED_BINS = [("<=0", None, 0), ("1-7", 1, 7), *PRESENT_BINS[2:]]
QUEUE_BINS = [("0-7", 0, 7), ("8-30", 8, 30), ("31-90", 31, 90), ("91-180", 91, 180),
              ("181-365", 181, 365), (">365", 366, None)]
LAG_METRICS = {"present": ("days_ahead_vs_nvd_present", PRESENT_BINS),
               "published": ("days_ahead_vs_nvd_published", PUBLISHED_BINS)}


def in_bin(value: Column, low: int | None, high: int | None) -> Column:
    if low is None:
        return value <= high
    return value >= low if high is None else value.between(low, high)


def bin_counts(value: Column, bins: list) -> list[Column]:
    return [F.count_if(in_bin(value, low, high)).alias(f"bin_{i}")
            for i, (_, low, high) in enumerate(bins)]


def quantile(value: Column, share: float) -> Column:
    """Exact interpolated percentile without the last bits of float noise."""
    return F.round(F.percentile(value, share), 6)


def check_maturity(maturity: str | None) -> None:
    if maturity not in (None, "all", *MATURITIES):
        raise ValueError(f"unknown maturity {maturity!r}")


def pending_rows(facts: DataFrame, affected: DataFrame, *, tech: str | None = None,
                 period: str | None = None, granularity: str = "month",
                 maturity: str = "all") -> DataFrame:
    check_maturity(maturity)
    rows = facts.where("pending")
    if maturity != "all":
        rows = rows.where(F.col("maturity") == maturity)
    if period:
        start, end = period_bounds(period, granularity)
        rows = rows.where((F.col("first_seen_at") >= ts(start)) & (F.col("first_seen_at") < ts(end)))
    return with_product(rows, affected, tech=tech)


def pending_top(facts: DataFrame, affected: DataFrame, kind: str = "product", top: int = 20,
                **filters) -> DataFrame:
    """Products by distinct pending candidates; distinct pairs spread a hot product."""
    pend = pending_rows(facts, affected, **filters).select("id")
    hits = matching_products(affected, kind, filters.get("tech")).select(
        "candidate_id", "product").distinct()
    return (pend.join(hits, F.col("id") == F.col("candidate_id"))
            .groupBy(F.col("product").alias("software")).agg(F.count("*").alias("pending"))
            .orderBy(F.desc("pending"), "software").limit(top))


def _total_and_maturity(pend: DataFrame, with_total: bool) -> DataFrame:
    """(dim, key, n) from one pass; maturity rows exist even when their count is 0."""
    row = pend.agg(F.count("*").alias("total"),
                   *[F.count_if(F.col("maturity") == m).alias(m) for m in MATURITIES])
    labels = [("total", "", "total")] if with_total else []
    labels += [("maturity", m, m) for m in MATURITIES]
    items = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(k).alias("key"),
                               F.col(c).alias("n")) for d, k, c in labels])
    return row.select(F.inline(items))


def pending_metrics(facts: DataFrame, affected: DataFrame, **filters) -> DataFrame:
    """Total, overlapping kinds and exact maturity split as (dim, key, n)."""
    pend = pending_rows(facts, affected, **filters).select("id", "maturity")
    kinds = affected.where(F.col("kind").isNotNull() & (F.col("kind") != "")).select(
        "candidate_id", F.col("kind").alias("key")).distinct()
    by_kind = (pend.join(kinds, F.col("id") == F.col("candidate_id"))
               .groupBy("key").agg(F.count("*").alias("n"))
               .select(F.lit("kind").alias("dim"), "key", "n"))
    return _total_and_maturity(pend, True).unionByName(by_kind)


def pending_breakdown(facts: DataFrame, affected: DataFrame) -> DataFrame:
    pend = facts.where("pending").select("id", "maturity")
    eco = affected.where(F.col("kind").isNull() | (F.col("kind") != "malware")).select(
        "candidate_id", F.coalesce("ecosystem", F.lit(NO_ECOSYSTEM)).alias("key")).distinct()
    by_eco = (pend.join(eco, F.col("id") == F.col("candidate_id"))
              .groupBy("key").agg(F.count("*").alias("n"))
              .select(F.lit("eco").alias("dim"), "key", "n"))
    return _total_and_maturity(pend, False).unionByName(by_eco)


def trend_series(facts: DataFrame, published: DataFrame, affected: DataFrame, p: Params,
                 granularity: str = "month", months: int = 12, days: int | None = None,
                 kind: str | None = None, tech: str | None = None,
                 include_historical: bool = False) -> DataFrame:
    cutoff = ts(window_start(p.as_of, granularity, months, days))
    pub = published.where((F.col("state") == "PUBLISHED")
                          & (F.col("cvelist_published_at") >= cutoff))
    if not include_historical:
        pub = pub.where(operational_published(p))
    pub = pub.groupBy(period_label(F.col("cvelist_published_at"), granularity).alias("period")
                      ).agg(F.count("*").alias("published"))
    rows = facts.where("pending_base" if include_historical else "pending").where(
        F.col("first_seen_at") >= cutoff)
    from advisorylake.operators.predicates import maturity_of

    pre = (with_product(rows.withColumn("stage", maturity_of()), affected, kind, tech)
           .groupBy(period_label(F.col("first_seen_at"), granularity).alias("period"))
           .agg(F.count("*").alias("pre_published"),
                *[F.count_if(F.col("stage") == m).alias(m) for m in MATURITIES]))
    return pub.join(pre, "period", "full").fillna(0).orderBy("period")


def operational_start(published: DataFrame, p: Params) -> DataFrame:
    """One row: the day the catalogue was first observed, unless forced."""
    if p.op_start:
        return published.sparkSession.range(1).select(ts(p.op_start).alias("op_start"))
    return published.agg(
        F.coalesce(F.date_trunc("day", F.min("nvd_first_observed_at")), ts(p.op_min_date))
        .alias("op_start"))


def operational_start_column(published: DataFrame, p: Params) -> Column:
    """The same value as a scalar subquery; building a report runs no job."""
    return ts(p.op_start) if p.op_start else operational_start(published, p).scalar()


def lag_rows(leads: DataFrame, published: DataFrame, mentions: DataFrame, sources: DataFrame,
             p: Params, months: int = 12, drop_backfill: bool = True,
             metric: str = "present", source: str | None = None,
             include_historical: bool = False) -> DataFrame:
    if metric not in LAG_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    rows = leads.where(F.col("merged_into").isNull())
    if include_historical:
        rows = rows.where((F.col("first_seen_at") >= ts(window_start(p.as_of, "month", months)))
                          & (F.col("first_seen_at") >= ts(p.min_valid_date)))
    else:
        rows = rows.where(F.col("first_seen_at") >= operational_start_column(published, p))
    # The archive is the very subject of the published lag, so it stays in.
    if drop_backfill and metric != "published":
        rows = exclude_backfill(rows, mentions, sources, p)
    return with_source(rows, mentions, sources, source)


def lag_histogram(rows: DataFrame, metric: str = "present") -> DataFrame:
    """count, median, p90 and bins in one pass; the exact percentile keeps one counter per
    distinct day value and merges partial counters."""
    name, bins = LAG_METRICS[metric]
    lead = F.col(name)
    return rows.agg(
        F.count(lead).alias("n"), quantile(lead, 0.5).alias("median"),
        quantile(lead, 0.9).alias("p90"), *bin_counts(lead, bins))


def lag_censored(rows: DataFrame, published: DataFrame) -> DataFrame:
    dated = published.where(F.col("nvd_published_at").isNotNull()).select(
        F.col("id").alias("key"))
    return (rows.where(F.col("cve_id").isNotNull())
            .join(dated, F.col("cve_id") == F.col("key"), "left_anti")
            .agg(F.count("*").alias("censored_count")))


def lag_by_year(rows: DataFrame, metric: str = "published") -> DataFrame:
    lead = F.col(LAG_METRICS[metric][0])
    return (rows.where(lead.isNotNull()).groupBy(F.year("first_seen_at").alias("year"))
            .agg(F.count("*").alias("n"), F.round(F.avg(lead), 1).alias("mean"),
                 quantile(lead, 0.5).alias("median")).orderBy("year"))


def queue_age(facts: DataFrame, mentions: DataFrame, sources: DataFrame, p: Params,
              drop_backfill: bool = True) -> DataFrame:
    rows = facts.where(F.col("pending") & (F.col("first_seen_at") >= ts(p.min_valid_date)))
    if drop_backfill:
        rows = exclude_backfill(rows, mentions, sources, p)
    aged = rows.select(
        F.when(F.col("cve_id").isNull(), "unassigned").otherwise("assigned").alias("grp"),
        age_days(F.col("first_seen_at"), p.as_of).alias("age"))
    return aged.groupBy("grp").agg(
        F.count("*").alias("total"), quantile(F.col("age"), 0.5).alias("median_days"),
        *bin_counts(F.col("age"), QUEUE_BINS))


def maturity_funnel(facts: DataFrame, published: DataFrame, p: Params) -> DataFrame:
    start = operational_start_column(published, p)
    base = facts.where(F.col("funnel_base") & (F.col("first_seen_at") >= start))
    silent, has_cve = ~F.col("nvd_spoke"), F.col("cve_id").isNotNull()
    return base.agg(
        F.count_if(F.col("nvd_spoke")).alias("published"),
        F.count_if(silent & has_cve & F.col("has_mirror")).alias("cve_reserved"),
        F.count_if(silent & has_cve & ~F.col("has_mirror")).alias("cve_prereserved"),
        F.count_if(silent & ~has_cve).alias("pre_cve"))


def capture_velocity(candidates: DataFrame, p: Params, days: int = 60) -> DataFrame:
    span = max(1, min(days, 400))
    cutoff = ts(p.as_of - dt.timedelta(days=span))
    return (candidates.where(F.col("merged_into").isNull() & (F.col("created_at") >= cutoff))
            .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"))
            .agg(F.count("*").alias("n")).orderBy("day"))


def mention_velocity(candidates: DataFrame, mentions: DataFrame, p: Params,
                     hours: int = 24) -> DataFrame:
    """Mentions per candidate in the last span against the one before.

    Mentions are reduced per candidate first; the join then sees one row per candidate.
    """
    recent = ts(p.as_of - dt.timedelta(hours=hours))
    before = ts(p.as_of - dt.timedelta(hours=2 * hours))
    seen = F.col("seen_at")
    counts = mentions.groupBy("candidate_id").agg(
        F.count_if(seen >= recent).alias("last_n"),
        F.count_if((seen < recent) & (seen >= before)).alias("prev_n"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
    ).where(F.col("last_n") > 0)
    live = candidates.where(F.col("merged_into").isNull()).select("id", "cve_id")
    return (live.join(counts, F.col("id") == F.col("candidate_id")).drop("candidate_id")
            .orderBy(F.desc("last_n"), "id"))


def _lead_by_source(leads: DataFrame, mentions: DataFrame, sources: DataFrame) -> DataFrame:
    lead = F.col("days_ahead_vs_nvd_present")
    rows = leads.where(lead.isNotNull() & F.col("merged_into").isNull())
    pairs = candidate_sources(mentions, sources).select("candidate_id", "source").distinct()
    return rows.join(pairs, F.col("id") == F.col("candidate_id"))


def source_stats(leads: DataFrame, mentions: DataFrame, sources: DataFrame, p: Params,
                 include_historical: bool = False) -> DataFrame:
    lead = F.col("days_ahead_vs_nvd_present")
    rows = leads.where((lead <= p.max_lead_days)
                       & (F.col("first_seen_at") >= ts(p.min_valid_date)))
    if not include_historical:
        rows = rows.where(operational_candidate(p))
    return (_lead_by_source(rows, mentions, sources).groupBy("source")
            .agg(F.round(F.avg(lead), 1).alias("avg_days"), F.count("*").alias("candidates"))
            .orderBy(F.desc("avg_days"), "source"))


def source_stats_cli(leads: DataFrame, mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """Unscoped variant plus the promotion rate repeated on each row."""
    lead = F.col("days_ahead_vs_nvd_present")
    per_source = (_lead_by_source(leads, mentions, sources).groupBy("source")
                  .agg(F.round(F.avg(lead), 1).alias("avg_days_ahead"),
                       F.count("*").alias("candidates")))
    return per_source.orderBy(F.desc("avg_days_ahead"), "source")


def promotion_rate(candidates: DataFrame) -> DataFrame:
    live = candidates.where(F.col("merged_into").isNull())
    return live.agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("status") == "published").alias("promoted"),
        F.coalesce(F.round(F.try_divide(
            F.count_if(F.col("status") == "published") * 100.0, F.count("*")), 1), F.lit(0.0))
        .alias("promotion_rate_pct"))
