"""Days of lead over NVD."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.functions.dates import days_between, ts
from advisorylake.operators.predicates import spread_nulls

# Fixed value: an observation later than this after NVD's own date says nothing about us.
OBSERVATION_LAG_MAX_DAYS = 30
LEADS = ["days_ahead_vs_nvd_published", "days_ahead_vs_nvd_present",
         "days_ahead_vs_nvd_analyzed"]
OPEN_STATUSES = ["candidate", "emerging"]


def _observed(observed: str) -> Column:
    late = days_between(F.col(observed), F.col("nvd_published_at")) > OBSERVATION_LAG_MAX_DAYS
    return F.when(~F.coalesce(late, F.lit(False)),
                  days_between(F.col(observed), F.col("first_seen_at")))


def mirror_dates(published: DataFrame) -> DataFrame:
    return published.select(
        F.col("id").alias("mirror_key"), "nvd_published_at", "nvd_first_observed_at",
        "nvd_first_analyzed_observed_at")


def days_ahead(candidates: DataFrame, published: DataFrame) -> DataFrame:
    """Candidates with the three leads; null where the catalogue has no row."""
    base = candidates.drop(*LEADS)
    key = spread_nulls(F.col("cve_id"), F.col("id"))
    return (
        base.join(mirror_dates(published), key == F.col("mirror_key"), "left")
        .withColumn(LEADS[0], days_between(F.col("nvd_published_at"), F.col("first_seen_at")))
        .withColumn(LEADS[1], _observed("nvd_first_observed_at"))
        .withColumn(LEADS[2], _observed("nvd_first_analyzed_observed_at"))
        .drop("mirror_key", "nvd_published_at", "nvd_first_observed_at",
              "nvd_first_analyzed_observed_at")
    )


def reconcile_leads(candidates: DataFrame, published: DataFrame,
                    as_of: dt.datetime) -> DataFrame:
    """Rows whose leads or status change once the catalogue is consulted again.

    Only live rows with a catalogue entry and something still open are considered.
    """
    old = {c: F.col(c) if c in candidates.columns else F.lit(None).cast("int") for c in LEADS}
    promoted = (F.col("promoted_at") if "promoted_at" in candidates.columns
                else F.lit(None).cast("timestamp"))
    due = (
        candidates
        .select("id", "cve_id", "status", "first_seen_at", "merged_into",
                promoted.alias("promoted_at"), *[old[c].alias(f"old_{c}") for c in LEADS])
        .where(F.col("merged_into").isNull() & F.col("cve_id").isNotNull()
               & F.col("status").isin(*OPEN_STATUSES, "published"))
        .where(F.col(f"old_{LEADS[1]}").isNull() | F.col("status").isin(OPEN_STATUSES))
    )
    joined = due.join(mirror_dates(published), F.col("cve_id") == F.col("mirror_key"))
    promotes = F.col("nvd_published_at").isNotNull() & F.col("status").isin(OPEN_STATUSES)
    known = F.col("first_seen_at").isNotNull()
    fresh = {
        LEADS[0]: days_between(F.col("nvd_published_at"), F.col("first_seen_at")),
        LEADS[1]: _observed("nvd_first_observed_at"),
        LEADS[2]: _observed("nvd_first_analyzed_observed_at"),
    }
    out = joined.select(
        "id", "cve_id", F.col("status").alias("old_status"),
        F.when(known & promotes, "published").otherwise(F.col("status")).alias("status"),
        F.when(known & promotes, F.coalesce(F.col("promoted_at"), ts(as_of)))
        .otherwise(F.col("promoted_at")).alias("promoted_at"),
        *[F.when(known, expr).otherwise(F.col(f"old_{c}")).alias(c) for c, expr in fresh.items()],
        *[F.col(f"old_{c}") for c in LEADS],
    )
    changed = ~F.col("status").eqNullSafe(F.col("old_status"))
    for c in LEADS:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return out.where(changed).select("id", "cve_id", "old_status", "status", "promoted_at", *LEADS)
