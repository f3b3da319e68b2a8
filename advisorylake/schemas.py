"""Table schemas, keys and enum domains."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B, TS, DT = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
    T.BooleanType(), T.TimestampType(), T.DateType(),
)
STRINGS = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


IDENTIFIER = _struct(scheme=S, value=S)
VERSION_RANGE = _struct(introduced=S, fixed=S, last_affected=S, version_type=S, raw=S)
AFFECTED_ITEM = _struct(
    product=S, vendor=S, ecosystem=S, purl=S, kind=S, exact_versions=STRINGS,
    ranges=T.ArrayType(VERSION_RANGE),
)
FLAGS = _struct(in_kev=B, kev_date=DT, kev_source=S, has_public_poc=B)

# The contract between every scan and ingestion.
MENTION_SCHEMA = _struct(
    url=S, title=S, snippet=S, cve_id=S, native_id=S, extra_ids=STRINGS, raw_html=S,
    seen_at=TS, flags=FLAGS, affected=T.ArrayType(AFFECTED_ITEM), cvss_vectors=STRINGS,
    cwe_ids=STRINGS, reference_urls=STRINGS, withdrawn=B,
)

TABLES: dict[str, T.StructType] = {
    "published_cves": _struct(
        id=S, state=S, cvelist_published_at=TS, cvelist_updated_at=TS, assigner_short_name=S,
        cna=S, raw_json=S, nvd_published_at=TS, nvd_last_modified_at=TS, nvd_vuln_status=S,
        nvd_first_observed_at=TS, nvd_first_analyzed_observed_at=TS, description_en=S,
        primary_cvss_version=S, primary_cvss_score=D, primary_cvss_severity=S,
        primary_cvss_vector=S, primary_cwe=S, has_exploit_ref=B, has_patch_ref=B,
        ssvc_exploitation=S, ssvc_automatable=S, ssvc_technical_impact=S, enriched_at=TS,
    ),
    "cve_cvss": _struct(
        cve_id=S, version=S, source=S, type=S, vector=S, base_score=D, base_severity=S,
        exploitability_score=D, impact_score=D,
    ),
    "cve_cwe": _struct(cve_id=S, cwe_id=S, description=S, source=S),
    "cve_cpe": _struct(
        cve_id=S, cpe23=S, vulnerable=B, version_start=S, version_start_type=S,
        version_end=S, version_end_type=S, source=S,
    ),
    "cve_reference": _struct(cve_id=S, url=S, tags=STRINGS, source=S),
    "epss_scores": _struct(
        cve_id=S, scored_date=DT, score=D, percentile=D, model_version=S,
    ),
    "sources": _struct(
        id=I, name=S, kind=S, method=S, tier=I, enabled=B, cadence_seconds=I,
        last_success_at=TS, last_error=S, last_error_at=TS,
    ),
    "candidates": _struct(
        id=S, status=S, cve_id=S, merged_into=S, first_seen_at=TS, last_seen_at=TS,
        mention_count=I, source_count=I, promoted_at=TS, days_ahead_vs_nvd_published=I,
        days_ahead_vs_nvd_present=I, days_ahead_vs_nvd_analyzed=I, affected_product=S,
        affected_versions=S, vuln_type=S, attack_vector=S, requires_auth=B,
        requires_interaction=B, has_public_poc=B, poc_urls=STRINGS, cwe_ids=STRINGS,
        reference_urls=STRINGS, withdrawn=B, severity_hint=S, in_kev=B, kev_date=DT,
        kev_source=S, enrichment_confidence=D, enrichment_method=S,
        enrichment_updated_at=TS, created_at=TS,
    ),
    "identifiers": _struct(scheme=S, value=S, candidate_id=S),
    "mentions": _struct(
        id=L, candidate_id=S, source_id=I, extracted_cve=S, extracted_native=S, url=S,
        title=S, snippet=S, seen_at=TS, content_hash=S,
    ),
    "cve_soft_references": _struct(
        mention_id=L, cve_id=S, source_id=I, from_candidate_id=S, context=S,
    ),
    "candidate_links": _struct(a=S, b=S, method=S, confidence=D, status=S),
    "cvss_scores": _struct(
        candidate_id=S, version=S, vector=S, base_score=D, base_severity=S, provenance=S,
        source=S, inferred_metrics=STRINGS, confidence=D,
    ),
    "affected_products": _struct(
        candidate_id=S, vendor=S, product=S, ecosystem=S, purl=S, kind=S,
        exact_versions=STRINGS, catalog_id=L, normalization_method=S, raw=S, source=S,
        ranges=T.ArrayType(VERSION_RANGE),
    ),
    "product_catalog": _struct(id=L, vendor=S, product=S, ecosystem=S, cpe23=S, purl=S),
    "product_aliases": _struct(alias_normalized=S, catalog_id=L, confidence=D),
    "github_repos": _struct(
        full_name=S, origin=S, repo_kind=S, stars=I, priority=I, watermark=S,
        last_scanned_at=TS, adv_watermark=S, adv_last_scanned_at=TS,
    ),
    "sync_state": _struct(id=S, cursor=S, extra=S, updated_at=TS),
}

# Unique keys; groupBy treats nulls as equal, which is what the product key declares.
KEYS: dict[str, list[str]] = {
    "published_cves": ["id"],
    "epss_scores": ["cve_id", "scored_date"],
    "sources": ["name"],
    "candidates": ["id"],
    "identifiers": ["scheme", "value"],
    "mentions": ["source_id", "content_hash"],
    "cve_soft_references": ["mention_id", "cve_id"],
    "candidate_links": ["a", "b"],
    "cvss_scores": ["candidate_id", "version", "provenance", "source"],
    "affected_products": ["candidate_id", "vendor", "product", "ecosystem"],
    "product_aliases": ["alias_normalized"],
    "github_repos": ["full_name"],
    "sync_state": ["id"],
}

# Stored domains of the enum-like columns.
CVE_STATES = ["RESERVED", "PUBLISHED", "REJECTED"]
CANDIDATE_STATUSES = ["candidate", "emerging", "published", "merged", "rejected"]
ATTACK_VECTORS = ["network", "adjacent", "local", "physical"]
SEVERITY_HINTS = ["likely-critical", "likely-high", "likely-medium", "likely-low"]
PROVENANCES = ["authoritative", "derived"]
CVSS_VERSIONS = ["3.0", "3.1", "4.0"]
CVSS_SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
LINK_METHODS = ["fingerprint", "embedding", "llm"]
LINK_STATUSES = ["suggested", "confirmed", "rejected"]
NORMALIZATION_METHODS = ["exact", "alias", "fuzzy", "llm", "unresolved"]
AFFECTED_STATUSES = ["affected", "unaffected", "unknown"]
ALIAS_SOURCES = ["seed", "llm", "manual"]
SOURCE_METHODS = ["api", "rss", "scrape", "browser", "git"]
MATURITIES = ["pre_cve", "cve_prereserved", "cve_reserved"]
