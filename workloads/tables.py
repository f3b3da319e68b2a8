"""Merges, audits, repository queue, enrichment and status over the driver tables."""

from __future__ import annotations

import datetime as dt

from advisorylake import schemas as S
from advisorylake.functions import software as SW
from advisorylake.operators import aggregates as A
from advisorylake.operators import audit as AU
from advisorylake.operators import enrichment as EN
from advisorylake.operators import merge as M
from advisorylake.operators import repos as RP
from advisorylake.operators.versioned import VersionedTable
from advisorylake.plans import lists as L
from advisorylake.session import scratch_path
from workloads.common import Ctx, F, P, Registry
from workloads.ingestion import vector_column, _CVSS_SQL, _VEC_SQL

reg = Registry()
add = reg.add
AS_OF = "TIMESTAMP '2001-12-01'"

# ---- merges: part of each table is the target, a changed part arrives ---------------
NVD_COLS = ["id", "state", "cvelist_published_at", "nvd_published_at", "nvd_first_observed_at",
            "nvd_first_analyzed_observed_at"]


def _num(c: str = "id"):
    """The number inside a catalogue id."""
    return F.substring(F.col(c), 10, 20).cast("long")


_NUM = "CAST(substring(id, 10) AS BIGINT)"


#: Running numbers of catalogue ids that share a bucket.
THOUSANDS = "substring({0}, 1, length({0}) - 3)"


def _stored(target, changes, key, apply, cluster=None):
    """The table after an upsert into the buckets of a stored one."""
    path = scratch_path(target.sparkSession, "stored")
    return VersionedTable.create(target, path, key, 16, cluster).upsert(changes, apply).read()


def _old_mirror(c: Ctx):
    return c.published_cves.where(_num() % 3 != 1).select(*NVD_COLS)


def _cvelist_changes(c: Ctx):
    return c.published_cves.where(_num() % 3 != 0).select(
        "id", F.when(_num() % 5 != 0, "REJECTED").alias("state"),
        (F.col("cvelist_published_at") + F.expr("INTERVAL 1 DAY")).alias("cvelist_published_at"))


add("merge_cvelist", lambda c: _stored(_old_mirror(c), _cvelist_changes(c), ["id"], lambda old, new: M.merge_cvelist(old, new, P.as_of), [THOUSANDS.format("id")]),
    f"SELECT id, CASE WHEN {_NUM} % 3 = 0 THEN state WHEN {_NUM} % 5 <> 0 THEN 'REJECTED' ELSE 'PUBLISHED' END AS state, "
    f"CASE WHEN {_NUM} % 3 = 0 THEN cvelist_published_at ELSE cvelist_published_at + INTERVAL 1 DAY END AS cvelist_published_at, "
    f"CASE WHEN {_NUM} % 3 <> 1 THEN nvd_published_at END AS nvd_published_at, CASE WHEN {_NUM} % 3 <> 1 THEN nvd_first_observed_at END AS nvd_first_observed_at, "
    f"CASE WHEN {_NUM} % 3 <> 1 THEN nvd_first_analyzed_observed_at END AS nvd_first_analyzed_observed_at FROM published_cves")


def _nvd_changes(c: Ctx):
    return c.published_cves.where((_num() % 4 != 0) | (_num() % 3 == 1)).select(
        "id", F.when(_num() % 5 == 0, F.lit("2001-01-01").cast("timestamp")).alias("nvd_published_at"),
        F.lit("2001-02-01").cast("timestamp").alias("nvd_last_modified_at"),
        F.when(_num() % 2 == 0, "Analyzed").alias("nvd_vuln_status"))


_TOUCH = f"({_NUM} % 4 <> 0 OR {_NUM} % 3 = 1)"
_KNOWN = f"({_NUM} % 3 <> 1)"
add("merge_nvd",
    lambda c: _stored(_old_mirror(c), _nvd_changes(c), ["id"], lambda old, new: M.merge_nvd(old, new, P.as_of), [THOUSANDS.format("id")]).drop("cvelist_published_at"),
    f"SELECT id, CASE WHEN {_KNOWN} THEN state ELSE 'PUBLISHED' END AS state, "
    f"coalesce(CASE WHEN {_TOUCH} AND {_NUM} % 5 = 0 THEN TIMESTAMP '2001-01-01' END, CASE WHEN {_KNOWN} THEN nvd_published_at END) AS nvd_published_at, "
    f"coalesce(CASE WHEN {_KNOWN} THEN nvd_first_observed_at END, CASE WHEN {_TOUCH} THEN {AS_OF} END) AS nvd_first_observed_at, "
    f"coalesce(CASE WHEN {_KNOWN} THEN nvd_first_analyzed_observed_at END, CASE WHEN {_TOUCH} AND {_NUM} % 2 = 0 THEN {AS_OF} END) AS nvd_first_analyzed_observed_at "
    f"FROM published_cves WHERE {_KNOWN} OR {_TOUCH}")
add("merge_epss",
    lambda c: _stored(
        c.epss_scores.where(_num("cve_id") % 3 != 1).select("*", F.lit("v1").alias("model_version")),
        c.epss_scores.where(_num("cve_id") % 3 != 0).select(
            "cve_id", "scored_date", (F.col("score") / 2).alias("score"), F.lit("v2").alias("model_version")),
        ["cve_id", "scored_date"], M.merge_epss, ["scored_date", THOUSANDS.format("cve_id")])
    .withColumn("score", F.round("score", 6)),
    "SELECT cve_id, scored_date, round(CASE WHEN n % 3 = 0 THEN score ELSE score / 2 END, 6) AS score, "
    "CASE WHEN n % 3 = 0 THEN 'v1' ELSE 'v2' END AS model_version FROM "
    "(SELECT *, CAST(substring(cve_id, 10) AS BIGINT) AS n FROM epss_scores)")


def _products(c: Ctx):
    """One row per product key; the lens may hold several kinds under one key."""
    return c.affected_products.groupBy(*M.AFFECTED_KEY).agg(F.max("kind").alias("kind"))


_PROD = ", prod AS (SELECT candidate_id, vendor, product, ecosystem, max(kind) AS kind FROM affected_products GROUP BY ALL) "
add("merge_affected_structured",
    lambda c: _stored(
        _products(c).where(F.col("candidate_id") % 3 != 1),
        _products(c).where(F.col("candidate_id") % 3 != 0).select(
            *M.AFFECTED_KEY, F.when(F.col("candidate_id") % 2 == 0, "product").alias("kind"), F.col("candidate_id").alias("arrival")).unionByName(
            _products(c).where(F.col("candidate_id") % 9 == 4).select(*M.AFFECTED_KEY, F.lit("late").alias("kind"), (F.col("candidate_id") + 1).alias("arrival"))),
        M.AFFECTED_KEY, M.merge_affected_structured, ["candidate_id"]),
    _PROD + "SELECT candidate_id, vendor, product, ecosystem, CASE WHEN candidate_id % 3 = 0 THEN kind WHEN candidate_id % 9 = 4 THEN 'late' "
    "WHEN candidate_id % 2 = 0 THEN 'product' END AS kind FROM prod")
add("merge_affected_llm",
    lambda c: _stored(
        _products(c).where(F.col("candidate_id") % 3 != 1),
        _products(c).where(F.col("candidate_id") % 3 != 0).select(
            "candidate_id", "vendor", "product", F.when(F.col("ecosystem") == "pypi", "PIP").otherwise(F.col("ecosystem")).alias("ecosystem"),
            F.lit("llm").alias("kind"), F.col("candidate_id").alias("arrival")), M.AFFECTED_KEY, M.merge_affected_llm, ["candidate_id"]),
    _PROD + "SELECT candidate_id, vendor, product, ecosystem, CASE WHEN candidate_id % 3 = 1 THEN 'llm' ELSE kind END AS kind FROM prod")


def _scored(c: Ctx, keep, source: str):
    return c.candidates.where(keep).select(
        F.col("id").alias("candidate_id"), F.lit("3.1").alias("version"), F.lit("authoritative").alias("provenance"),
        F.lit(source).alias("source"), F.lit("old").alias("vector"), F.lit(1.0).alias("base_score"))


add("merge_cvss",
    lambda c: _stored(
        _scored(c, "id % 3 <> 1", "osv"),
        M.structured_cvss(c.candidates.where("id % 3 <> 0").select(
            F.col("id").alias("candidate_id"), F.col("id").alias("arrival"), F.array(
                F.lit("cvss:3.1/av:n/ac:l/pr:n/ui:n/s:u/c:n/i:n/a:l"), vector_column(F.col("id")), F.lit("CVSS:3.1/AV:BAD"), F.lit("AV:N/AC:L"))
            .alias("cvss_vectors"))), M.CVSS_KEY, M.merge_cvss, ["candidate_id"]),
    _CVSS_SQL + "SELECT id AS candidate_id, '3.1' AS version, 'authoritative' AS provenance, 'osv' AS source, "
    "CASE WHEN id % 3 = 0 THEN 'old' ELSE vector END AS vector, CASE WHEN id % 3 = 0 THEN 1.0 ELSE score END AS base_score FROM z")
add("merge_identifiers",
    lambda c: _stored(
        c.identifiers.where(F.col("candidate_id") % 3 != 1),
        c.identifiers.where(F.col("candidate_id") % 3 != 0).select("scheme", "value", (F.col("candidate_id") + 1000000000).alias("candidate_id"), F.col("candidate_id").alias("arrival")),
        ["scheme", "value"], M.merge_identifiers),
    "SELECT scheme, value, CASE WHEN candidate_id % 3 = 1 THEN candidate_id + 1000000000 ELSE candidate_id END AS candidate_id FROM identifiers")
add("merge_soft_refs",
    lambda c: _stored(
        c.candidates.where("cve_id IS NOT NULL AND id % 3 <> 1").select(F.col("id").alias("mention_id"), "cve_id", F.lit("old").alias("context")),
        c.candidates.where("cve_id IS NOT NULL AND id % 3 <> 0").select(F.col("id").alias("mention_id"), "cve_id", F.lit("new").alias("context"), F.col("id").alias("arrival")),
        ["mention_id", "cve_id"], M.merge_soft_refs),
    "SELECT id AS mention_id, cve_id, CASE WHEN id % 3 = 1 THEN 'new' ELSE 'old' END AS context FROM candidates WHERE cve_id IS NOT NULL")
add("merge_repos",
    lambda c: M.merge_repos(
        c.repos.where(F.col("priority") > 0).select("full_name", F.lit("manual").alias("origin"), "stars", "priority", F.lit("project").alias("repo_kind")),
        c.repos.where(F.col("priority") != 10).select("full_name", F.when(F.col("priority") == 20, "past_cve").alias("origin"),
                                          F.when(F.col("stars") % 2 == 0, F.lit(7)).alias("stars"))),
    "SELECT full_name, CASE WHEN priority > 0 THEN 'manual' ELSE 'reference' END AS origin, "
    "coalesce(CASE WHEN priority <> 10 AND stars % 2 = 0 THEN 7 END, CASE WHEN priority > 0 THEN stars END) AS stars, "
    "CASE WHEN priority = 0 THEN 10 ELSE priority END AS priority, CASE WHEN priority > 0 THEN 'project' ELSE repo_kind END AS repo_kind FROM repos")


def _marks(c: Ctx):
    return c.repos.select("full_name", "last_scanned_at", "stars", F.when(
        F.col("stars") % 2 == 0, "2001-06-01T00:00:00+00:00").alias("watermark"))


add("merge_scan_mark",
    lambda c: M.merge_scan_mark(_marks(c), _marks(c).where("stars % 3 = 0").select(
        "full_name", F.when(F.col("stars") % 5 == 0, "2001-03-01T00:00:00+00:00").when(
            F.col("stars") % 5 == 1, "2001-09-01T00:00:00+00:00").alias("watermark")), P.as_of).drop("stars"),
    f"SELECT full_name, CASE WHEN stars % 3 = 0 THEN {AS_OF} ELSE last_scanned_at END AS last_scanned_at, "
    "CASE WHEN stars % 3 = 0 AND stars % 5 = 1 THEN '2001-09-01T00:00:00+00:00' WHEN stars % 2 = 0 THEN '2001-06-01T00:00:00+00:00' "
    "WHEN stars % 3 = 0 AND stars % 5 = 0 THEN '2001-03-01T00:00:00+00:00' END AS watermark FROM repos")


def _state(c: Ctx):
    return c.sources.select(
        F.concat(F.when(F.col("id") % 5 == 0, "runtime:").otherwise("source:"), "name").alias("id"),
        F.date_format("last_success_at", "yyyy-MM-dd").alias("cursor"), F.lit(None).cast("string").alias("extra"),
        F.col("last_success_at").alias("updated_at"), F.col("id").alias("n"))


add("merge_cursor",
    lambda c: M.merge_cursor(
        _state(c).where("n % 3 <> 1").drop("n"),
        _state(c).where("n % 3 <> 0").select("id", F.lit("new").alias("cursor"), F.lit("{}").alias("extra")), P.as_of),
    "SELECT CASE WHEN id % 5 = 0 THEN 'runtime:' ELSE 'source:' END || name AS id, CASE WHEN id % 3 = 0 THEN strftime(last_success_at, '%Y-%m-%d') ELSE 'new' END AS cursor, "
    f"CASE WHEN id % 3 <> 0 THEN '{{}}' END AS extra, CASE WHEN id % 3 = 0 THEN last_success_at ELSE {AS_OF} END AS updated_at FROM sources")


def _code_registry(c: Ctx):
    return c.sources.where("id % 4 <> 0").select(
        F.when(F.col("id") % 6 == 1, F.concat("name", F.lit("_NEW"))).otherwise(F.col("name")).alias("name"), F.lit("k").alias("kind"),
        F.lit("api").alias("method"), (F.col("tier") % 5 + 1).alias("tier"), F.lit(60).alias("cadence_seconds"))


add("merge_sources_registry",
    lambda c: M.merge_sources_registry(
        c.sources.select("name", F.lit("old").alias("kind"), "method", "tier", "enabled", "cadence_seconds"), _code_registry(c)),
    "SELECT name, CASE WHEN k THEN 'k' ELSE 'old' END AS kind, CASE WHEN k THEN 'api' ELSE method END AS method, CASE WHEN k THEN tier % 5 + 1 ELSE tier END AS tier, "
    "enabled AND k AS enabled, cadence_seconds FROM (SELECT *, id % 4 <> 0 AND id % 6 <> 1 AS k FROM sources) "
    "UNION ALL SELECT name || '_NEW', 'k', 'api', tier % 5 + 1, TRUE, 60 FROM sources WHERE id % 4 <> 0 AND id % 6 = 1")
add("zombie_sources",
    lambda c: M.zombie_sources(c.sources, _code_registry(c)).select("name"),
    "SELECT name FROM sources WHERE enabled AND NOT (id % 4 <> 0 AND id % 6 <> 1)")
add("replace_children",
    lambda c: _stored(
        c.identifiers.where("scheme = 'CVE'").select(F.col("value").alias("cve_id"), F.lit("old").alias("cwe_id"), "candidate_id"),
        c.identifiers.where((F.col("scheme") == "CVE") & (F.col("candidate_id") % 3 == 1)).select(
            F.col("value").alias("cve_id"), F.explode(F.array(F.lit("CWE-1"), F.lit("CWE-2"))).alias("cwe_id"), "candidate_id", F.lit(False).alias("gone")).unionByName(
            c.identifiers.where((F.col("scheme") == "CVE") & (F.col("candidate_id") % 3 != 0)).select(F.col("value").alias("cve_id"), F.lit(True).alias("gone")),
            allowMissingColumns=True),
        ["cve_id", "cwe_id"], lambda old, new: M.replace_children(old, new.where("NOT gone"), new.where("gone")), [THOUSANDS.format("cve_id")]),
    "SELECT value AS cve_id, 'old' AS cwe_id, candidate_id FROM identifiers WHERE scheme = 'CVE' AND candidate_id % 3 = 0 "
    "UNION ALL SELECT value, unnest(['CWE-1', 'CWE-2']), candidate_id FROM identifiers WHERE scheme = 'CVE' AND candidate_id % 3 = 1")
add("refresh_candidates",
    lambda c: A.refresh_candidates(c.candidates, c.mentions).select(
        "id", "status", "mention_count", "source_count", "first_seen_at", "last_seen_at"),
    ", m AS (SELECT candidate_id, count(*) AS n, count(DISTINCT source_id) AS s, min(seen_at) AS lo, max(seen_at) AS hi FROM mentions GROUP BY 1) "
    "SELECT id, CASE WHEN status = 'candidate' AND n >= 1 THEN 'emerging' ELSE status END AS status, coalesce(n, 0) AS mention_count, "
    "coalesce(s, 0) AS source_count, coalesce(lo, first_seen_at) AS first_seen_at, coalesce(hi, last_seen_at) AS last_seen_at "
    "FROM candidates LEFT JOIN m ON m.candidate_id = id")

# ---- audits and status ------------------------------------------------------------


def _dirty(c: Ctx):
    """The lens tables with planted violations."""
    return {
        "published_cves": c.published_cves.withColumn("state", F.when(_num() % 50 == 0, "ODD").otherwise(F.col("state"))),
        "candidates": c.candidates.withColumn("attack_vector", F.when(F.col("id") % 100 == 3, "web").otherwise(F.col("attack_vector"))),
        "sources": c.sources.withColumn("tier", F.when(F.col("id") == 3, 9).otherwise(F.col("tier"))),
        "cvss_scores": c.cvss_scores.withColumn("base_score", F.col("base_score") + 0.5).withColumn(
            "confidence", F.when(F.col("candidate_id") % 5 == 0, 1.5)).withColumn("base_severity", F.when(F.col("candidate_id") % 3 == 0, "SEVERE").otherwise("LOW")),
        "epss_scores": c.epss_scores.withColumn("percentile", F.col("score") * 2),
        "candidate_links": c.candidates.select(
            F.col("id").alias("a"), (F.col("id") + 1 - F.col("id") % 4).alias("b"), F.when(F.col("id") % 6 == 0, "guess").otherwise("llm").alias("method"),
            F.lit("confirmed").alias("status"), (F.col("id") % 3).alias("confidence")),
        "affected_products": c.affected_products.withColumn("normalization_method", F.when(F.col("candidate_id") % 2 == 0, "magic")),
    }


def _doubled(c: Ctx):
    """Lens tables in which some rows stand twice."""
    again = {
        "published_cves": (c.published_cves, _num() % 40 == 0), "candidates": (c.candidates, F.col("id") % 100 == 3),
        "identifiers": (c.identifiers, F.col("candidate_id") % 50 == 1), "epss_scores": (c.epss_scores, _num("cve_id") % 10 == 0),
        "sources": (c.sources, F.col("id") % 5 == 2)}
    return {name: df.unionByName(df.where(some)) for name, (df, some) in again.items()}


add("audit_constraints", lambda c: AU.audit_constraints(_dirty(c)),
    f"SELECT 'published_cves' AS table_name, 'state_domain' AS rule, count(*) FILTER (WHERE {_NUM} % 50 = 0) AS violations FROM published_cves "
    "UNION ALL SELECT 'sources', 'method_domain', 0 UNION ALL SELECT 'sources', 'tier_range', count(*) FILTER (WHERE id = 3) FROM sources "
    "UNION ALL SELECT 'candidates', 'status_domain', 0 UNION ALL SELECT 'candidates', 'attack_vector_domain', count(*) FILTER (WHERE id % 100 = 3) FROM candidates "
    "UNION ALL SELECT 'candidates', 'severity_hint_domain', 0 UNION ALL SELECT 'cvss_scores', 'provenance_domain', 0 "
    "UNION ALL SELECT 'cvss_scores', 'score_range', count(*) FILTER (WHERE base_score + 0.5 > 10) FROM cvss_scores "
    "UNION ALL SELECT 'cvss_scores', 'version_domain', 0 UNION ALL SELECT 'epss_scores', 'score_range', 0 "
    "UNION ALL SELECT 'cvss_scores', 'confidence_range', count(*) FILTER (WHERE candidate_id % 5 = 0) FROM cvss_scores "
    "UNION ALL SELECT 'cvss_scores', 'severity_domain', count(*) FILTER (WHERE candidate_id % 3 = 0) FROM cvss_scores "
    "UNION ALL SELECT 'epss_scores', 'percentile_range', count(*) FILTER (WHERE score * 2 > 1) FROM epss_scores "
    "UNION ALL SELECT 'candidate_links', 'method_domain', count(*) FILTER (WHERE id % 6 = 0) FROM candidates UNION ALL SELECT 'candidate_links', 'status_domain', 0 "
    "UNION ALL SELECT 'candidate_links', 'confidence_range', count(*) FILTER (WHERE id % 3 = 2) FROM candidates "
    "UNION ALL SELECT 'candidate_links', 'ordered_pair', count(*) FILTER (WHERE id % 4 <> 0) FROM candidates "
    "UNION ALL SELECT 'affected_products', 'normalization_domain', count(*) FILTER (WHERE candidate_id % 2 = 0) FROM affected_products")
add("audit_uniqueness",
    lambda c: AU.audit_uniqueness({
        "affected_products": (c.affected_products, M.AFFECTED_KEY),
        **{name: (twice, S.KEYS[name]) for name, twice in _doubled(c).items()}}),
    "SELECT 'affected_products' AS table_name, count(*) AS duplicate_keys FROM (SELECT 1 FROM affected_products GROUP BY candidate_id, vendor, product, ecosystem HAVING count(*) > 1) "
    f"UNION ALL SELECT 'published_cves', count(*) FROM published_cves WHERE {_NUM} % 40 = 0 "
    "UNION ALL SELECT 'candidates', count(*) FROM candidates WHERE id % 100 = 3 "
    "UNION ALL SELECT 'identifiers', count(*) FROM identifiers WHERE candidate_id % 50 = 1 "
    "UNION ALL SELECT 'epss_scores', count(*) FROM epss_scores WHERE CAST(substring(cve_id, 10) AS BIGINT) % 10 = 0 "
    "UNION ALL SELECT 'sources', count(*) FROM sources WHERE id % 5 = 2")
add("audit_references",
    lambda c: AU.audit_references([
        ("mentions.candidate_id", c.mentions, "candidate_id", c.candidates.where("id % 7 <> 0"), "id"),
        ("mentions.source_id", c.mentions, "source_id", c.sources, "id"),
        ("candidates.merged_into", c.candidates, "merged_into", c.candidates, "id"),
        ("candidates.cve_id", c.candidates, "cve_id", c.published_cves, "id")]),
    "SELECT 'mentions.candidate_id' AS link, count(*) AS orphans FROM mentions WHERE candidate_id % 7 = 0 "
    "UNION ALL SELECT 'mentions.source_id', 0 UNION ALL SELECT 'candidates.merged_into', 0 "
    "UNION ALL SELECT 'candidates.cve_id', count(*) FROM candidates WHERE cve_id IS NOT NULL AND id % 2 = 1")
#: Declared columns that the lens does not fill.
_LENS_LACKS = {
    "identifiers": "", "epss_scores": "model_version,percentile", "sources": "kind,last_error",
    "cvss_scores": "base_severity,confidence,inferred_metrics,source,vector",
    "github_repos": "adv_last_scanned_at,adv_watermark,origin,repo_kind,watermark",
    "mentions": "content_hash,extracted_cve,extracted_native,id,snippet,title,url",
    "affected_products": "catalog_id,exact_versions,normalization_method,purl,ranges,raw,source",
    "candidates": "affected_product,affected_versions,cwe_ids,days_ahead_vs_nvd_analyzed,days_ahead_vs_nvd_present,days_ahead_vs_nvd_published,"
                  "enrichment_confidence,enrichment_method,enrichment_updated_at,kev_date,kev_source,mention_count,poc_urls,promoted_at,"
                  "reference_urls,requires_auth,requires_interaction,source_count",
    "published_cves": "assigner_short_name,cna,cvelist_updated_at,description_en,enriched_at,has_exploit_ref,has_patch_ref,nvd_last_modified_at,"
                      "nvd_vuln_status,primary_cvss_score,primary_cvss_severity,primary_cvss_vector,primary_cvss_version,primary_cwe,raw_json,"
                      "ssvc_automatable,ssvc_exploitation,ssvc_technical_impact",
}
add("audit_schema",
    lambda c: AU.audit_schema({name: getattr(c, name) for name in _LENS_LACKS}),
    " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{lacks}' AS missing, count(*) AS rows FROM {name}" for name, lacks in _LENS_LACKS.items()))
_AGE = f"CAST(floor((epoch_us({AS_OF}) - epoch_us(last_success_at)) / 1e6) AS BIGINT)"
_STATE = (f"CASE WHEN NOT enabled THEN 'disabled' WHEN last_error_at IS NOT NULL AND (last_success_at IS NULL OR last_error_at >= last_success_at) THEN 'error' "
          f"WHEN last_success_at IS NULL THEN 'never' WHEN {_AGE} > greatest(cadence_seconds * 2, 900) THEN 'stale' ELSE 'ok' END")
add("source_state",
    lambda c: AU.source_rows(c.sources, P.as_of).select("name", "state", "success_age_seconds", "stale_after_seconds"),
    f"SELECT name, {_STATE} AS state, {_AGE} AS success_age_seconds, greatest(cadence_seconds * 2, 900) AS stale_after_seconds FROM sources")
add("source_health", lambda c: AU.source_health(c.sources, P.as_of),
    f", st AS (SELECT *, {_STATE} AS state FROM sources), cnt AS (SELECT 'total' AS item, count(*) AS n FROM st UNION ALL SELECT 'enabled', count(*) FILTER (WHERE enabled) FROM st "
    "UNION ALL SELECT v.s, (SELECT count(*) FROM st WHERE state = v.s) FROM (VALUES ('ok'), ('active'), ('queued'), ('error'), ('stale'), ('never'), ('disabled')) v(s)) "
    "SELECT item, n FROM cnt UNION ALL SELECT 'alert:sources_' || item, n FROM cnt WHERE item IN ('error', 'stale', 'never') AND n > 0")
add("cursor_ages", lambda c: AU.cursor_ages(_state(c).drop("n"), P.as_of),
    f"SELECT 'source:' || name AS id, strftime(last_success_at, '%Y-%m-%d') AS cursor, last_success_at AS updated_at, {_AGE} AS age_seconds FROM sources WHERE id % 5 <> 0")
_OLD = "(cve_id IS NOT NULL AND substring(cve_id, 5, 4) < '1996')"
_EARLY = "(first_seen_at < TIMESTAMP '1996-06-01')"
add("ingestion_status",
    lambda c: AU.ingestion_status(c.facts, c.mentions, c.affected_products, c.published_cves, P.op_min_date, P.op_year),
    "SELECT 'candidates' AS item, count(*) AS n FROM candidates WHERE merged_into IS NULL UNION ALL SELECT 'mentions', count(*) FROM mentions "
    "UNION ALL SELECT 'affected_products', count(*) FROM affected_products UNION ALL SELECT 'published_cves', count(*) FROM published_cves "
    "UNION ALL SELECT 'nvd_published', count(nvd_published_at) FROM published_cves UNION ALL SELECT 'rejected_cves', count(*) FROM published_cves WHERE state = 'REJECTED' "
    "UNION ALL SELECT 'pending_operational', count(*) FROM facts WHERE pending "
    f"UNION ALL SELECT 'historical_pending', count(*) FROM facts WHERE pending_base AND {_EARLY} AND NOT {_OLD} "
    f"UNION ALL SELECT 'source_inconsistencies', count(*) FROM facts WHERE pending_base AND {_OLD} "
    f"UNION ALL SELECT 'historical_inconsistencies', count(*) FROM facts WHERE pending_base AND ({_EARLY} OR {_OLD})")
add("repo_scan_status", lambda c: AU.repo_scan_status(c.repos),
    "SELECT count(*) AS total, count(last_scanned_at) AS commits_scanned, count(*) - count(last_scanned_at) AS commits_pending, "
    "count(adv_last_scanned_at) AS advisories_scanned, count(*) - count(adv_last_scanned_at) AS advisories_pending FROM repos")
add("source_listing",
    lambda c: c.sources.select("name", "method", "tier", "enabled").orderBy(F.desc("enabled"), "tier", "name"),
    "SELECT name, method, tier, enabled FROM sources")

# ---- repositories -----------------------------------------------------------------
_QUEUE = ("SELECT full_name, priority, stars FROM repos WHERE ({m} IS NULL OR {m} < " + AS_OF + " - INTERVAL 6 HOUR) {x} "
          "ORDER BY priority DESC, {m} ASC NULLS FIRST, stars DESC NULLS LAST, full_name LIMIT 40")
add("repo_next_batch",
    lambda c: RP.repo_next_batch(c.repos, P.as_of, 40).select("full_name", "priority", "stars"),
    _QUEUE.format(m="last_scanned_at", x=""))
add("repo_next_batch_adv",
    lambda c: RP.repo_next_batch_adv(c.repos, P.as_of, 40).select("full_name", "priority", "stars"),
    _QUEUE.format(m="adv_last_scanned_at", x="AND (repo_kind IS NULL OR repo_kind <> 'poc')"))


def _urls(c: Ctx):
    def link(n):
        return F.concat(F.lit("https://github.com/own"), (n % 40).cast("string"), F.lit("/rep"), (n % 90).cast("string"), F.lit("/commit/x"))

    mentions = c.mentions.select(link(F.col("candidate_id")).alias("url"), F.when(F.col("candidate_id") % 3 == 0, "CVE-2001-0001").alias("extracted_cve"))
    refs = c.published_cves.select(F.concat(F.lit("see github.com/cat/"), F.col("state"), F.lit(".git")).alias("url"))
    cands = c.candidates.select("cve_id", F.when(F.col("id") % 2 == 0, F.array(
        F.concat(F.lit("https://www.github.com/list/r"), (F.col("id") % 77).cast("string")), F.lit("https://gist.github.com/a/b"))).alias("reference_urls"))
    return RP.three_stream_refs(mentions, refs, cands)


_URLS = (", u AS (SELECT 'own' || (candidate_id % 40) || '/rep' || (candidate_id % 90) AS repo, candidate_id % 3 = 0 AS w FROM mentions "
         "UNION ALL SELECT 'cat/' || state, FALSE FROM published_cves UNION ALL SELECT 'list/r' || (id % 77), cve_id IS NOT NULL FROM candidates WHERE id % 2 = 0) ")
add("three_stream_refs",
    lambda c: _urls(c).groupBy("url").agg(F.count("*").alias("n"), F.count_if("with_cve").alias("n_cve")),
    ", t AS (SELECT 'https://github.com/own' || (candidate_id % 40) || '/rep' || (candidate_id % 90) || '/commit/x' AS url, candidate_id % 3 = 0 AS w FROM mentions "
    "UNION ALL SELECT 'see github.com/cat/' || state || '.git', FALSE FROM published_cves "
    "UNION ALL SELECT unnest(['https://www.github.com/list/r' || (id % 77), 'https://gist.github.com/a/b']), cve_id IS NOT NULL FROM candidates WHERE id % 2 = 0) "
    "SELECT url, count(*) AS n, count(*) FILTER (WHERE w) AS n_cve FROM t GROUP BY 1")
add("harvest_references", lambda c: RP.harvest_references(_urls(c)),
    _URLS + "SELECT repo AS full_name, CASE WHEN bool_or(w) THEN 'past_cve' ELSE 'reference' END AS origin FROM u GROUP BY 1")
add("criticality_topn",
    lambda c: RP.criticality_topn(c.candidates.select(
        F.concat(F.lit("https://github.com/own"), (F.col("id") % 40).cast("string"), F.lit("/rep"), F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 7 == 0, "n/a").otherwise((F.col("id") % 1000 / 1000.0).cast("string")).alias("default_score")), 500)
    .select("full_name", F.round("score", 6).alias("score")),
    "SELECT 'own' || (id % 40) || '/rep' || id AS full_name, round(sc, 6) AS score FROM (SELECT *, CASE WHEN id % 7 = 0 THEN 0.0 ELSE (id % 1000) / 1000.0 END AS sc FROM candidates) "
    "ORDER BY sc DESC, 'https://github.com/own' || (id % 40) || '/rep' || id LIMIT 500")

# ---- enrichment -------------------------------------------------------------------


def _doc_mentions(c: Ctx):
    """Mentions with prose, several per candidate, in explicit order."""
    return c.planted.select(
        (F.col("doc_id") % 60).alias("candidate_id"), F.col("doc_id").alias("id"),
        F.concat(F.lit("T "), (F.col("doc_id") % 7).cast("string")).alias("title"), F.col("text").alias("snippet"))


_PIECES = (", pieces AS (SELECT doc_id % 60 AS candidate_id, doc_id AS id, 'T ' || (doc_id % 7) || ' ' || text AS piece FROM planted), "
           "firsts AS (SELECT candidate_id, piece, min(id) AS first_id FROM pieces GROUP BY 1, 2), "
           "topk AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY first_id) AS position FROM firsts) ")
add("snippets_topk",
    lambda c: A.snippets_topk(_doc_mentions(c), 40).select(
        "candidate_id", F.col("position").cast("long").alias("position"), F.md5("piece").alias("piece")),
    _PIECES + "SELECT candidate_id, position, md5(piece) AS piece FROM topk WHERE position <= 40")


def _signals(c: Ctx):
    n = F.col("doc_id")
    return c.planted.select(n.alias("candidate_id"), F.concat(
        "text", F.when(n % 5 == 0, " remote code execution; ").when(n % 5 == 1, " AuthenticationBypass / auth bypass ").when(
            n % 5 == 2, " mysqli sql-injection xss ").when(n % 5 == 3, " crosssite scripting ").otherwise(" plain "),
        F.when(n % 2 == 0, " unauthenticated PoC https://poc.example/a https://poc.example/a ").otherwise("")).alias("text"))


add("heuristic_enrich",
    lambda c: EN.heuristic_enrich(_signals(c)).select(
        "candidate_id", "vuln_type", "attack_vector", "requires_auth", "has_public_poc", F.size("poc_urls").alias("n_urls"), "confidence"),
    ", d AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' remote code execution; ' WHEN 1 THEN ' AuthenticationBypass / auth bypass ' "
    "WHEN 2 THEN ' mysqli sql-injection xss ' WHEN 3 THEN ' crosssite scripting ' ELSE ' plain ' END || "
    "CASE WHEN doc_id % 2 = 0 THEN ' unauthenticated PoC https://poc.example/a https://poc.example/a ' ELSE '' END AS text FROM planted) "
    "SELECT doc_id AS candidate_id, CASE WHEN regexp_matches(text, '(?i)\\b(rce|remote code execution|code execution)\\b') THEN 'RCE' "
    "WHEN regexp_matches(text, '(?i)\\bauth(entication)?\\s*bypass\\b') THEN 'AuthBypass' WHEN regexp_matches(text, '(?i)\\b(sql[\\s-]?injection|sqli)\\b') THEN 'SQLi' "
    "WHEN regexp_matches(text, '(?i)\\b(xss|cross[\\s-]?site scripting)\\b') THEN 'XSS' END AS vuln_type, "
    "CASE WHEN regexp_matches(text, '(?i)\\b(remote|network|unauthenticated)\\b') THEN 'network' END AS attack_vector, "
    "CASE WHEN regexp_matches(text, '(?i)unauthenticated') THEN FALSE END AS requires_auth, "
    "regexp_matches(text, '(?i)\\b(poc|proof[\\s-]?of[\\s-]?concept|exploit)\\b') AS has_public_poc, "
    "CAST(len(list_distinct(regexp_extract_all(text, 'https?://\\S+')[1:5])) AS INTEGER) AS n_urls, 0.35::DOUBLE AS confidence FROM d")


def _responses(c: Ctx):
    products = F.concat(F.lit('[{"vendor":"v'), F.col("id").cast("string"), F.lit('","product":"p","versions_raw":"<2"},{"vendor":"nameless"}]'))
    body = F.concat(
        F.lit('{"affected_products":'), products, F.lit(',"vuln_type":"XSS","attack_vector":"'),
        F.when(F.col("id") % 4 == 0, "Network").when(F.col("id") % 4 == 1, "web").otherwise("local"), F.lit('","has_public_poc":'),
        F.when(F.col("id") % 3 == 0, "true").otherwise("false"), F.lit(',"poc_urls":["https://p.example/'), F.col("id").cast("string"), F.lit('","ftp://no"],"cvss_metrics":'),
        F.when(F.col("id") % 5 == 0, '{"attack_vector":"NETWORK","attack_complexity":"low","privileges_required":"none","user_interaction":"none",'
               '"scope":"unchanged","confidentiality":"high","integrity":"high","availability":"high"}').otherwise('{"scope":"odd"}'),
        F.lit(',"confidence":'), F.when(F.col("id") % 10 == 9, "1.5").otherwise("0.5"), F.lit(',"extra":1}'))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    return c.candidates.select(F.col("id").alias("candidate_id"), F.when(F.col("id") % 6 == 1, fenced).when(
        F.col("id") % 6 == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(F.col("id") % 6 == 3, "no json at all").otherwise(body).alias("response"))


_OK = "(id % 6 <> 3 AND id % 10 <> 9)"
add("parse_enrichment_output",
    lambda c: EN.parse_enrichment_output(_responses(c)).select(
        "candidate_id", "ok", "vuln_type", "attack_vector", "has_public_poc", "confidence",
        F.array_join(F.transform("affected_products", lambda p: F.concat(p["vendor"], F.lit("/"), p["product"])), ",").alias("products"),
        F.array_join("poc_urls", " ").alias("urls")),
    f"SELECT id AS candidate_id, {_OK} AS ok, CASE WHEN {_OK} THEN 'XSS' END AS vuln_type, "
    f"CASE WHEN {_OK} THEN CASE id % 4 WHEN 0 THEN 'network' WHEN 1 THEN NULL ELSE 'local' END END AS attack_vector, "
    f"CASE WHEN {_OK} THEN id % 3 = 0 END AS has_public_poc, CASE WHEN {_OK} THEN 0.5::DOUBLE END AS confidence, "
    f"CASE WHEN {_OK} THEN 'v' || id || '/p' END AS products, CASE WHEN {_OK} THEN 'https://p.example/' || id END AS urls FROM candidates")
add("derived_cvss",
    lambda c: EN.derived_cvss(EN.parse_enrichment_output(_responses(c))).select(
        "candidate_id", "version", "vector", "base_score", "base_severity", "provenance"),
    "SELECT id AS candidate_id, '3.1' AS version, 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' AS vector, 9.8::DOUBLE AS base_score, "
    f"'CRITICAL' AS base_severity, 'derived' AS provenance FROM candidates WHERE {_OK} AND id % 5 = 0")


def _enrichable(c: Ctx):
    return c.candidates.select(
        "id", "vuln_type", "attack_vector", "has_public_poc", "severity_hint", F.lit(None).cast("string").alias("affected_product"),
        F.when(F.col("id") % 2 == 0, "earlier").alias("enrichment_method"), F.lit(None).cast("timestamp").alias("enrichment_updated_at"))


add("apply_enrichment",
    lambda c: EN.apply_enrichment(
        _enrichable(c), EN.parse_enrichment_output(_responses(c)).where("candidate_id % 7 <> 0"), c.cvss_scores.select("candidate_id", "base_score"),
        P.as_of, "model").select("id", "vuln_type", "attack_vector", "has_public_poc", "severity_hint", "affected_product",
                                 "enrichment_method", "enrichment_updated_at"),
    f", e AS (SELECT *, id % 7 <> 0 AS tried, id % 7 <> 0 AND {_OK} AS ok, CASE id % 4 WHEN 0 THEN 'network' WHEN 1 THEN NULL ELSE 'local' END AS av, "
    "id % 4 <> 0 AND EXISTS (SELECT 1 FROM cvss_scores v WHERE v.candidate_id = c.id AND v.base_score IS NOT NULL) AS scored FROM candidates c) "
    "SELECT id, CASE WHEN ok THEN 'XSS' ELSE vuln_type END AS vuln_type, CASE WHEN ok THEN coalesce(av, attack_vector) ELSE attack_vector END AS attack_vector, "
    "CASE WHEN has_public_poc THEN TRUE WHEN ok THEN id % 3 = 0 ELSE has_public_poc END AS has_public_poc, "
    "CASE WHEN NOT ok THEN severity_hint WHEN scored THEN NULL WHEN 2 + CASE WHEN av = 'network' THEN 2 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END >= 4 THEN 'likely-high' "
    "ELSE 'likely-medium' END AS severity_hint, CASE WHEN ok THEN 'v' || id || '/p' END AS affected_product, "
    "CASE WHEN ok THEN 'model' WHEN tried AND id % 2 <> 0 THEN 'llm-failed' WHEN id % 2 = 0 THEN 'earlier' END AS enrichment_method, "
    f"CASE WHEN tried THEN {AS_OF} END AS enrichment_updated_at FROM e")


def _stamped(c: Ctx):
    agg = A.candidate_aggregates(c.mentions).select(F.col("candidate_id").alias("k"), "mention_count")
    return c.candidates.join(agg, F.col("id") == F.col("k"), "left").withColumn(
        "enrichment_updated_at", F.when(F.col("id") % 3 == 0, F.lit("2001-11-30 12:00:00").cast("timestamp")).when(
            F.col("id") % 3 == 1, F.col("first_seen_at"))).fillna(0, ["mention_count"])


add("enrich_worklist",
    lambda c: EN.enrich_worklist(_stamped(c), c.mentions, P.as_of, 30).select("id", "last_seen_at", "mentions_since"),
    ", st AS (SELECT c.*, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2001-11-30 12:00:00' WHEN id % 3 = 1 THEN first_seen_at END AS stamp FROM candidates c "
    "WHERE merged_into IS NULL AND status IN ('candidate', 'emerging', 'published') AND EXISTS (SELECT 1 FROM mentions m WHERE m.candidate_id = c.id)), "
    "newest AS (SELECT * FROM st WHERE id % 3 <> 0 OR (SELECT count(*) FROM mentions m WHERE m.candidate_id = st.id AND m.seen_at > st.stamp) >= 3) "
    "SELECT id, last_seen_at, (SELECT count(*) FROM mentions m WHERE m.candidate_id = newest.id AND m.seen_at > newest.stamp) AS mentions_since "
    "FROM newest ORDER BY last_seen_at DESC, id LIMIT 30")
add("reenrich_due",
    lambda c: _stamped(c).where(EN.reenrich_due(F.col("enrichment_updated_at"), F.col("mention_count"), P.as_of, 24, 7)).select("id"),
    ", n AS (SELECT candidate_id, count(*) AS n FROM mentions GROUP BY 1) SELECT id FROM candidates LEFT JOIN n ON n.candidate_id = id WHERE id % 3 <> 0 OR n >= 7")
add("authoritative_first_by_version",
    lambda c: EN.authoritative_first_by_version(A.snippets_topk(_doc_mentions(c).withColumn("snippet", F.concat(
        "snippet", F.lit(" "), F.when(F.col("id") % 2 == 0, vector_column(F.col("id"))).otherwise("CVSS:3.1/AV:N/AC:L")))))
    .select("candidate_id", "version", "vector"),
    _PIECES.replace("text FROM planted", f"text || ' ' || CASE WHEN doc_id % 2 = 0 THEN {_VEC_SQL.replace('id //', 'doc_id //')} ELSE 'CVSS:3.1/AV:N/AC:L' END FROM planted")
    .replace("'T ' || (doc_id % 7) || ' ' || text || ' ' ||", "'T ' || (doc_id % 7) || ' ' || text || ' ' ||").replace("END FROM planted", "END AS piece FROM planted")
    + f"SELECT candidate_id, '3.1' AS version, arg_min(vec, position) AS vector FROM (SELECT candidate_id, position, first_id, {_VEC_SQL.replace('id //', 'first_id //')} AS vec "
    "FROM topk WHERE position <= 40 AND first_id % 2 = 0) GROUP BY 1")


def _aliases(c: Ctx):
    """Spellings of the whole catalogue, half of which name no entry yet."""
    p = c.driver("part").select("p_brand", "p_name").distinct()
    return p.groupBy(
        SW.normalize_key(F.concat_ws(" ", "p_brand", "p_name")).alias("alias_normalized")).agg(
        F.min(F.when(F.col("p_name").contains("e"), F.length("p_name"))).cast("long").alias("catalog_id"))


def _resolved(c: Ctx, vendor):
    names = c.affected_products.select(vendor.alias("vendor"), F.upper("product").alias("product")).distinct()
    return EN.resolve_products(names, _aliases(c))


add("join_alias_lookup",
    lambda c: _resolved(c, F.col("vendor")).select("vendor", "product", "catalog_id", "method"),
    "SELECT DISTINCT vendor, upper(product) AS product, CASE WHEN product LIKE '%e%' THEN length(product) END AS catalog_id, "
    "CASE WHEN product LIKE '%e%' THEN 'alias' ELSE 'unresolved' END AS method FROM affected_products")
add("product_resolution",
    lambda c: _resolved(c, F.concat(F.lit("  "), F.replace("vendor", F.lit("#"), F.lit(" -- ")))).select("product", "vendor", "method", "confidence"),
    "SELECT DISTINCT upper(product) AS product, '  ' || replace(vendor, '#', ' -- ') AS vendor, CASE WHEN product LIKE '%e%' THEN 'alias' ELSE 'unresolved' END AS method, "
    "CASE WHEN product LIKE '%e%' THEN 1.0 ELSE 0.0 END AS confidence FROM affected_products")


def _backfill(c: Ctx):
    ids = c.candidates.select(
        F.col("id").alias("candidate_id"), F.when(F.col("id") % 3 == 0, "GHCOMMIT").otherwise("OSV").alias("scheme"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("GHCOMMIT:Own/R"), F.col("id").cast("string"), F.lit("@abcdef0"))).when(
            F.col("id") % 5 == 1, F.concat(F.lit("MAL-2026-"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("OSV-2026-"), F.col("id").cast("string"))).alias("value"))
    rows = c.candidates.select(
        F.col("id").alias("candidate_id"), "id", F.when(F.col("id") % 3 == 2, F.concat(F.lit("Acme/Tool"), F.col("id").cast("string"), F.lit(": fix"))).alias("title"),
        F.when(F.col("id") % 3 == 1, F.concat(F.lit("x | affected: "), F.when(F.col("id") % 2 == 0, "Debian:12").otherwise("npm"), F.lit(":pkg"), F.col("id").cast("string"), F.lit(" <2"))).alias("snippet"))
    return EN.backfill_products(c.candidates, c.affected_products.where(F.col("candidate_id") % 2 == 0), ids, rows)


add("backfill_products", _backfill,
    "SELECT id AS candidate_id, CASE id % 3 WHEN 0 THEN 'own/r' || id WHEN 1 THEN CASE WHEN id % 2 = 0 THEN '12:pkg' ELSE 'pkg' END || id ELSE 'acme/tool' || id END AS product, "
    "CASE id % 3 WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'debian' ELSE 'npm' END ELSE 'github' END AS ecosystem, "
    "CASE WHEN id % 3 <> 0 AND id % 5 = 1 THEN 'malware' WHEN id % 3 = 1 AND id % 2 = 0 THEN 'distro' ELSE 'product' END AS kind FROM candidates c "
    "WHERE merged_into IS NULL AND NOT EXISTS (SELECT 1 FROM affected_products a WHERE a.candidate_id = c.id AND a.candidate_id % 2 = 0)")


def _detail(c: Ctx):
    """The parts of one candidate's page as (section, a, b) rows; the key is the CVE of the
    candidate with the most mentions."""
    busiest = (c.mentions.groupBy("candidate_id").agg(F.count("*").alias("n"))
               .join(c.candidates.where("merged_into IS NULL AND cve_id IS NOT NULL AND first_seen_at >= '1996-06-01' "
                                        "AND substring(cve_id, 5, 4) >= '1996'"), F.col("candidate_id") == F.col("id"))
               .orderBy(F.desc("n"), "id").select("cve_id").first())
    d = L.candidate_detail(
        busiest["cve_id"].lower(), candidates=c.candidates, identifiers=c.identifiers, cvss=c.cvss_scores, affected=c.affected_products,
        mentions=c.mentions, sources=c.sources, epss=c.epss_scores, p=P)
    parts = [
        d["candidate"].select(F.lit("candidate").alias("section"), F.col("cve_id").alias("a"), F.col("status").alias("b")),
        d["identifiers"].select(F.lit("identifier"), "scheme", "value"),
        d["cvss"].select(F.lit("cvss"), "version", "provenance"),
        d["affected"].select(F.lit("affected"), "product", "kind"),
        d["timeline"].select(F.lit("timeline"), F.col("position").cast("string"), "source"),
        d["epss"].select(F.lit("epss"), "cve_id", F.date_format("scored_date", "yyyy-MM-dd"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


add("candidate_detail", _detail,
    ", pick AS (SELECT c.* FROM candidates c JOIN (SELECT candidate_id, count(*) AS n FROM mentions GROUP BY 1) m ON m.candidate_id = c.id "
    "WHERE merged_into IS NULL AND cve_id IS NOT NULL AND first_seen_at >= TIMESTAMP '1996-06-01' AND substring(cve_id, 5, 4) >= '1996' ORDER BY n DESC, id LIMIT 1) "
    "SELECT 'candidate' AS section, cve_id AS a, status AS b FROM pick UNION ALL SELECT 'identifier', i.scheme, i.value FROM identifiers i JOIN pick ON pick.id = i.candidate_id "
    "UNION ALL SELECT 'cvss', v.version, v.provenance FROM cvss_scores v JOIN pick ON pick.id = v.candidate_id "
    "UNION ALL SELECT 'affected', a.product, a.kind FROM affected_products a JOIN pick ON pick.id = a.candidate_id "
    "UNION ALL SELECT 'timeline', CAST(row_number() OVER (ORDER BY m.seen_at, m.content_key) AS STRING), s.name FROM mentions m JOIN pick ON pick.id = m.candidate_id JOIN sources s ON s.id = m.source_id "
    "UNION ALL SELECT 'epss', e.cve_id, strftime(max(e.scored_date), '%Y-%m-%d') FROM epss_scores e JOIN pick USING (cve_id) GROUP BY e.cve_id")
