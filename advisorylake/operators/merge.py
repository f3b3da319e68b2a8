"""Keyed merges: read the target, full-outer join the changes, apply a rule per column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from advisorylake.functions.cvss import cvss3_base_score, cvss3_severity, vector_version
from advisorylake.functions.dates import ts
from advisorylake.functions.repos import classify_repo_kind, origin_priority
from advisorylake.functions.software import canonical_ecosystem, classify_kind
from advisorylake.functions.text import strip
from advisorylake.operators.stages import compute_once

# A rule sees the old and the new value of a column where both rows exist.
Rule = Callable[[Column, Column], Column]


def new(old: Column, fresh: Column) -> Column:
    return fresh


def keep(old: Column, fresh: Column) -> Column:
    return old


def new_or_old(old: Column, fresh: Column) -> Column:
    return F.coalesce(fresh, old)


def old_or_new(old: Column, fresh: Column) -> Column:
    return F.coalesce(old, fresh)


def highest(old: Column, fresh: Column) -> Column:
    return F.greatest(old, fresh)


def merge(target: DataFrame, changes: DataFrame, key: list[str],
          rules: dict[str, Rule]) -> DataFrame:
    """Target after an upsert. Keys compare null-safely; columns without a rule keep the
    old value. ``changes`` must be unique on the key (see :func:`latest`)."""
    t, c = target.alias("t"), changes.alias("c")
    on = None
    for k in key:
        same = F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}"))
        on = same if on is None else on & same
    joined = t.withColumn("_t", F.lit(True)).alias("t").join(
        c.withColumn("_c", F.lit(True)).alias("c"), on, "full")
    in_t, in_c = F.col("t._t").isNotNull(), F.col("c._c").isNotNull()
    out = []
    for name in target.columns:
        old = F.col(f"t.{name}")
        if name in key:
            out.append(F.when(in_t, old).otherwise(F.col(f"c.{name}")).alias(name))
        elif name not in changes.columns:
            out.append(old.alias(name))
        else:
            fresh = F.col(f"c.{name}")
            both = rules.get(name, keep)(old, fresh)
            out.append(F.when(in_t & in_c, both).when(in_c, fresh).otherwise(old).alias(name))
    return joined.select(*out)


def insert_new(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Do nothing on conflict; first arrival wins inside the batch."""
    keyed = target.select(*[F.col(k).alias(f"_{k}") for k in key])
    on = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    fresh = changes.join(keyed, on, "left_anti")
    return target.unionByName(fresh.select(*target.columns), allowMissingColumns=True)


def latest(rows: DataFrame, key: list[str], order: str = "arrival",
           first: bool = False) -> DataFrame:
    """Last (or first) row per key; the rank filter prunes on the map side."""
    by = F.asc(order) if first else F.desc(order)
    return (rows.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy(by)))
            .where("rn = 1").drop("rn"))


def merge_cvelist(published: DataFrame, records: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Catalogue columns are overwritten; NVD columns are never touched."""
    fresh = records.withColumn("state", F.coalesce("state", F.lit("PUBLISHED")))
    if "ingested_at" in published.columns:
        fresh = fresh.withColumn("ingested_at", ts(as_of))
    columns = ["state", "cvelist_published_at", "cvelist_updated_at", "assigner_short_name",
               "cna", "raw_json", "ingested_at"]
    return merge(published, fresh, ["id"], {c: new for c in columns})


def merge_nvd(published: DataFrame, records: DataFrame, observed_at: dt.datetime) -> DataFrame:
    """First observation is kept, first analysis is stamped once, dates are filled."""
    seen = ts(observed_at)
    fresh = (records.withColumn("state", F.lit("PUBLISHED"))
             .withColumn("nvd_first_observed_at", seen)
             .withColumn("nvd_first_analyzed_observed_at",
                         F.when(F.col("nvd_vuln_status") == "Analyzed", seen)))
    return merge(published, fresh, ["id"], {
        "nvd_published_at": new_or_old, "nvd_last_modified_at": new, "nvd_vuln_status": new,
        "nvd_first_observed_at": old_or_new, "nvd_first_analyzed_observed_at": old_or_new})


def merge_epss(scores: DataFrame, records: DataFrame) -> DataFrame:
    return merge(scores, records, ["cve_id", "scored_date"],
                 {"score": new, "percentile": new, "model_version": new})


AFFECTED_KEY = ["candidate_id", "vendor", "product", "ecosystem"]


def structured_affected(mentions: DataFrame) -> DataFrame:
    """candidate_id, arrival and the ``affected`` list as canonical product rows."""
    item = mentions.select("candidate_id", "arrival",
                           F.posexplode("affected").alias("pos", "a"))
    eco = F.col("a.ecosystem")
    return item.select(
        "candidate_id", F.col("a.vendor").alias("vendor"), F.col("a.product").alias("product"),
        canonical_ecosystem(eco).alias("ecosystem"), F.col("a.purl").alias("purl"),
        F.coalesce(F.when(F.col("a.kind") != "", F.col("a.kind")), classify_kind(eco)).alias("kind"),
        F.col("a.exact_versions").alias("exact_versions"), F.col("a.ranges").alias("ranges"),
        F.lit("structured").alias("source"), F.struct("arrival", "pos").alias("arrival"))


def merge_affected_structured(products: DataFrame, rows: DataFrame) -> DataFrame:
    """Last writer wins, nulls included; ranges travel with their row."""
    changes = latest(rows, AFFECTED_KEY)
    columns = ["purl", "kind", "exact_versions", "ranges"]
    return merge(products, changes, AFFECTED_KEY, {c: new for c in columns})


def merge_affected_llm(products: DataFrame, rows: DataFrame) -> DataFrame:
    """Extracted products never replace structured ones."""
    canonical = rows.withColumn("ecosystem", canonical_ecosystem(F.col("ecosystem")))
    return insert_new(products, latest(canonical, AFFECTED_KEY, first=True), AFFECTED_KEY)


CVSS_KEY = ["candidate_id", "version", "provenance", "source"]


def structured_cvss(mentions: DataFrame, source: str = "osv") -> DataFrame:
    """candidate_id, arrival and ``cvss_vectors`` as scored rows.

    Vectors are scored by formula and dropped when they cannot be: invalid v3 ones, and
    v4 ones, whose scoring needs a published table this package does not carry.
    """
    rows = mentions.select("candidate_id", "arrival",
                           F.posexplode("cvss_vectors").alias("pos", "v"))
    vector = F.upper(strip(F.col("v")))
    scored = compute_once(
        rows.select("candidate_id", "arrival", "pos", vector.alias("vector")),
        version=vector_version(F.col("vector")), base_score=cvss3_base_score(F.col("vector")))
    return scored.where(F.col("base_score").isNotNull()).select(
        "candidate_id", "version", "vector", "base_score",
        cvss3_severity(F.col("base_score")).alias("base_severity"),
        F.lit("authoritative").alias("provenance"), F.lit(source).alias("source"),
        F.struct("arrival", "pos").alias("arrival"))


def merge_cvss(scores: DataFrame, rows: DataFrame) -> DataFrame:
    changes = latest(rows.where(F.col("version").isNotNull()), CVSS_KEY)
    return merge(scores, changes, CVSS_KEY, {
        "vector": new, "base_score": new, "base_severity": new, "inferred_metrics": new,
        "confidence": new})


def merge_identifiers(identifiers: DataFrame, rows: DataFrame) -> DataFrame:
    return insert_new(identifiers, latest(rows, ["scheme", "value"], first=True),
                      ["scheme", "value"])


def merge_soft_refs(refs: DataFrame, rows: DataFrame) -> DataFrame:
    return insert_new(refs, latest(rows, ["mention_id", "cve_id"], first=True),
                      ["mention_id", "cve_id"])


def merge_repos(repos: DataFrame, found: DataFrame) -> DataFrame:
    """``found``: full_name, origin, stars?, priority?; priority only rises."""
    origin = F.coalesce("origin", F.lit("reference"))
    stars = F.col("stars") if "stars" in found.columns else F.lit(None).cast("int")
    priority = origin_priority(origin)
    if "priority" in found.columns:
        priority = F.coalesce(F.col("priority"), priority)
    rows = found.select("full_name", origin.alias("origin"), stars.alias("stars"),
                        priority.alias("priority"),
                        classify_repo_kind(F.col("full_name")).alias("repo_kind"))
    return merge(repos, rows, ["full_name"],
                 {"priority": highest, "stars": new_or_old, "repo_kind": old_or_new})


def merge_scan_mark(repos: DataFrame, scans: DataFrame, as_of: dt.datetime,
                    prefix: str = "") -> DataFrame:
    """``scans``: full_name, watermark. The mark always moves, the watermark only rises.

    ``prefix='adv_'`` selects the separate mark of the advisory scan.
    """
    mark, water = f"{prefix}last_scanned_at", f"{prefix}watermark"
    rows = scans.select(F.col("full_name").alias("_k"),
                        F.when(F.col("watermark") != "", F.col("watermark")).alias("_w"))
    joined = repos.join(rows, F.col("full_name") == F.col("_k"), "left")
    return joined.withColumns({
        mark: F.when(F.col("_k").isNotNull(), ts(as_of)).otherwise(F.col(mark)),
        water: F.greatest(F.col(water), F.col("_w")),
    }).select(*repos.columns)


def merge_cursor(state: DataFrame, cursors: DataFrame, as_of: dt.datetime) -> DataFrame:
    fresh = cursors.withColumn("updated_at", ts(as_of))
    return merge(state, fresh, ["id"], {"cursor": new, "extra": new, "updated_at": new})


def merge_sources_registry(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Code refreshes kind, method and tier; cadence is operator-owned; zombies go off."""
    fresh = registry.withColumn("enabled", F.lit(True))
    merged = merge(sources, fresh, ["name"], {"kind": new, "method": new, "tier": new})
    known = registry.select(F.col("name").alias("_n"))
    return merged.join(known, F.col("name") == F.col("_n"), "left").withColumn(
        "enabled", F.col("enabled") & F.col("_n").isNotNull()).select(*sources.columns)


def zombie_sources(sources: DataFrame, registry: DataFrame) -> DataFrame:
    return sources.where("enabled").join(registry.select("name"), "name", "left_anti")


def replace_children(target: DataFrame, rows: DataFrame, touched: DataFrame,
                     key: str = "cve_id") -> DataFrame:
    """Delete the children of every touched key, then insert the new ones."""
    kept = target.join(touched.select(key).distinct(), key, "left_anti")
    return kept.select(*target.columns).unionByName(rows.select(*target.columns))

