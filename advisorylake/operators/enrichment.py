"""Heuristic enrichment, parsed model output and how both reach the candidate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from advisorylake.functions.cvss import (
    cvss3_base_score, cvss3_severity, cvss_vectors_in_text, severity_hint, vector_from_metrics,
    vector_version,
)
from advisorylake.functions.dates import ts
from advisorylake.functions.software import normalize_key
from advisorylake.functions.text import strip
from advisorylake.operators.stages import compute_once
from advisorylake.functions.vocab import ALLOWED, clean_poc_urls, literal_normalise

# The type patterns in order of precedence, and the other text signals.
TYPE_PATTERNS = [
    ("RCE", r"(?i)\b(?:rce|remote code execution|code execution)\b"),
    ("AuthBypass", r"(?i)\bauth(?:entication)?\s*bypass\b"),
    ("SQLi", r"(?i)\b(?:sql[\s-]?injection|sqli)\b"),
    ("XSS", r"(?i)\b(?:xss|cross[\s-]?site scripting)\b"),
]
POC_PATTERN = r"(?i)\b(?:poc|proof[\s-]?of[\s-]?concept|exploit)\b"
NETWORK_PATTERN = r"(?i)\b(?:remote|network|unauthenticated)\b"
URL_PATTERN = r"https?://\S+"
HEURISTIC_CONFIDENCE = 0.35

PRODUCTS = ("array<struct<vendor:string,product:string,ecosystem:string,versions_raw:string,"
            "fixed_version:string>>")
METRICS = ",".join(f"{name}:string" for name in ALLOWED)
OUTPUT_SCHEMA = (
    f"affected_products {PRODUCTS}, vuln_type string, attack_vector string, "
    "requires_auth boolean, requires_interaction boolean, has_public_poc boolean, "
    f"poc_urls array<string>, cvss_metrics struct<{METRICS}>, summary string, confidence double")


def heuristic_enrich(texts: DataFrame) -> DataFrame:
    """candidate_id, text -> type, proof-of-concept, vector and first URLs by pattern."""
    text = F.col("text")
    kind = None
    for label, pattern in TYPE_PATTERNS:
        hit = text.rlike(pattern)
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
    return texts.select(
        "candidate_id", kind.alias("vuln_type"),
        F.when(text.rlike(NETWORK_PATTERN), "network").alias("attack_vector"),
        F.when(text.rlike("(?i)unauthenticated"), F.lit(False)).alias("requires_auth"),
        text.rlike(POC_PATTERN).alias("has_public_poc"),
        clean_poc_urls(F.slice(F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0)), 1, 5))
        .alias("poc_urls"),
        F.lit(HEURISTIC_CONFIDENCE).alias("confidence"))


def parse_enrichment_output(responses: DataFrame) -> DataFrame:
    """candidate_id, response -> typed fields; ``ok`` is false when it is not usable JSON.

    A fence is removed, then the text itself or, failing that, its outermost braces are
    parsed. Products without a name and words outside the vocabulary are dropped.
    """
    text = strip(F.col("response"))
    bare = F.when(text.startswith("```"),
                  strip(F.regexp_replace(text, r"^```[a-z]*\n?|\n?```$", ""))).otherwise(text)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)

    def read(source: Column) -> Column:
        return F.from_json(F.when(source.startswith("{"), source),
                           f"{OUTPUT_SCHEMA}, _bad string",
                           {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})

    usable = lambda o: o.isNotNull() & o["_bad"].isNull()
    tried = compute_once(responses.select("candidate_id", bare.alias("bare"), inner.alias("inner")),
                         whole=read(F.col("bare")), cut=read(F.col("inner")))
    whole, cut = F.col("whole"), F.col("cut")
    out = compute_once(tried.select("candidate_id", "whole", "cut"),
                       o=F.when(usable(whole), whole).when(usable(cut), cut))
    o = F.col("o")
    confidence = F.coalesce(o["confidence"], F.lit(0.0))
    ok = o.isNotNull() & confidence.between(0.0, 1.0)
    metrics = o["cvss_metrics"]
    cleaned = F.struct(*[literal_normalise(name, metrics[name]).alias(name) for name in ALLOWED])
    fields = {
        "affected_products": F.coalesce(
            F.filter(o["affected_products"], lambda p: p["product"].isNotNull()),
            F.array().cast(PRODUCTS)),
        "vuln_type": o["vuln_type"],
        "attack_vector": literal_normalise("attack_vector", o["attack_vector"]),
        "requires_auth": o["requires_auth"], "requires_interaction": o["requires_interaction"],
        "has_public_poc": o["has_public_poc"], "poc_urls": clean_poc_urls(o["poc_urls"]),
        "cvss_metrics": F.when(metrics.isNotNull(), cleaned), "summary": o["summary"],
        "confidence": confidence,
    }
    return out.select("candidate_id", F.coalesce(ok, F.lit(False)).alias("ok"),
                      *[F.when(ok, value).alias(name) for name, value in fields.items()])


def derived_cvss(parsed: DataFrame) -> DataFrame:
    """v3.1 rows from the eight inferred base metrics."""
    metrics = {name: F.col(f"cvss_metrics.{name}") for name in ALLOWED}
    rows = compute_once(parsed.where(F.col("cvss_metrics").isNotNull()),
                        vector=vector_from_metrics(metrics)).where(F.col("vector").isNotNull())
    rows = compute_once(rows.select("candidate_id", "confidence", "vector"),
                        base_score=cvss3_base_score(F.col("vector")))
    return rows.select(
        "candidate_id", F.lit("3.1").alias("version"), "vector", "base_score",
        cvss3_severity(F.col("base_score")).alias("base_severity"),
        F.lit("derived").alias("provenance"), F.lit("llm-derived").alias("source"), "confidence")


def authoritative_first_by_version(pieces: DataFrame) -> DataFrame:
    """candidate_id, position, piece -> first scorable vector per version."""
    found = pieces.select("candidate_id", "position",
                          F.posexplode(cvss_vectors_in_text(F.col("piece"))).alias("pos", "vector"))
    scored = compute_once(found, version=vector_version(F.col("vector")),
                          base_score=cvss3_base_score(F.col("vector"))).where(
        F.col("base_score").isNotNull())
    best = scored.groupBy("candidate_id", "version").agg(
        F.min_by(F.struct("vector", "base_score"), F.struct("position", "pos")).alias("row"))
    return best.select("candidate_id", "version", "row.*").withColumn(
        "base_severity", cvss3_severity(F.col("base_score")))


def apply_enrichment(candidates: DataFrame, parsed: DataFrame, scored: DataFrame,
                     as_of: dt.datetime, method: str) -> DataFrame:
    """Candidates after enrichment.

    A null never erases a value, a known proof of concept stays, and the qualitative hint
    exists only where no numeric score does. ``scored`` has candidate_id and base_score; rows
    without a score do not count. An
    unusable answer stamps the attempt so the candidate waits for its next turn.
    """
    out = parsed.select(F.col("candidate_id").alias("_k"),
                        *[F.col(c).alias(f"_{c}") for c in parsed.columns if c != "candidate_id"])
    has = scored.where(F.col("base_score").isNotNull()).select(F.col("candidate_id").alias("_s")).distinct()
    joined = candidates.join(out, F.col("id") == F.col("_k"), "left").join(
        has, F.col("id") == F.col("_s"), "left")
    ok, tried = F.coalesce(F.col("_ok"), F.lit(False)), F.col("_k").isNotNull()
    failed = tried & ~ok & F.col("enrichment_method").isNull()
    first = F.try_element_at("_affected_products", F.lit(1))
    label = F.when(F.coalesce(first["vendor"], F.lit("")) != "",
                   F.concat(first["vendor"], F.lit("/"), first["product"])).otherwise(
        first["product"])
    hint = F.when(F.col("_s").isNull(), severity_hint(
        F.col("_vuln_type"), F.col("_attack_vector"), F.col("_has_public_poc")))
    updates = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in
               ("vuln_type", "attack_vector", "requires_auth", "requires_interaction")}
    updates["has_public_poc"] = F.when(F.col("has_public_poc"), F.lit(True)).otherwise(
        F.coalesce(F.col("_has_public_poc"), F.col("has_public_poc")))
    updates["affected_product"] = F.coalesce(label, F.col("affected_product"))
    updates["affected_versions"] = F.when(label.isNotNull(), first["versions_raw"]).otherwise(
        F.col("affected_versions"))
    updates["poc_urls"] = F.when(F.size("_poc_urls") > 0, F.array_distinct(F.concat(
        F.coalesce("poc_urls", F.array().cast("array<string>")), F.col("_poc_urls")))
    ).otherwise(F.col("poc_urls"))
    updates["severity_hint"] = F.when(ok, hint).otherwise(F.col("severity_hint"))
    updates["enrichment_confidence"] = F.when(ok, F.col("_confidence")).when(
        failed, F.lit(0.0)).otherwise(F.col("enrichment_confidence"))
    updates["enrichment_method"] = F.when(ok, F.lit(method)).when(
        failed, F.lit("llm-failed")).otherwise(F.col("enrichment_method"))
    updates["enrichment_updated_at"] = F.when(tried, ts(as_of)).otherwise(
        F.col("enrichment_updated_at"))
    have = set(candidates.columns)
    return joined.withColumns({c: v for c, v in updates.items() if c in have}).select(
        *candidates.columns)


def reenrich_due(enriched_at: Column, mentions_since: Column, as_of: dt.datetime,
                 hours: int = 24, min_new: int = 3) -> Column:
    age = (F.unix_micros(ts(as_of)) - F.unix_micros(enriched_at)) / F.lit(3600e6)
    return enriched_at.isNull() | (age >= hours) | (mentions_since >= min_new)


def enrich_worklist(candidates: DataFrame, mentions: DataFrame, as_of: dt.datetime,
                    limit: int = 50, hours: int = 24, min_new: int = 3,
                    look_back: int | None = None) -> DataFrame:
    """The ``limit`` newest live candidates that are due.

    ``look_back`` restricts the search to so many of the newest; None looks at all. New
    mentions only matter where the last enrichment is recent, so only those candidates meet
    the mention table.
    """
    live = candidates.where(
        F.col("merged_into").isNull() & F.col("status").isin("candidate", "emerging", "published")
        & (F.col("mention_count") >= 1)).select("id", "last_seen_at", "enrichment_updated_at")
    if look_back is not None:
        live = live.orderBy(F.desc("last_seen_at"), "id").limit(look_back)
    stamp = F.col("enrichment_updated_at")
    # Without a stamp no mention is newer, with an old one the candidate is due anyway.
    small = live.where(~reenrich_due(stamp, F.lit(0), as_of, hours, min_new)).select(
        F.col("id").alias("candidate_id"), stamp.alias("stamp"))

    def newer(stamps: DataFrame) -> DataFrame:
        return (mentions.join(stamps, "candidate_id").where(F.col("seen_at") > F.col("stamp"))
                .groupBy(F.col("candidate_id").alias("_k")).agg(F.count("*").alias("mentions_since")))

    known = live.join(newer(small), F.col("id") == F.col("_k"), "left")
    due = reenrich_due(stamp, F.coalesce("mentions_since", F.lit(0)), as_of, hours, min_new)
    rows = (known.where(due).orderBy(F.desc("last_seen_at"), "id").limit(limit)
            .select("id", "last_seen_at", stamp.alias("stamp")))
    counts = newer(rows.select(F.col("id").alias("candidate_id"), "stamp"))
    return (rows.join(counts, F.col("id") == F.col("_k"), "left")
            .select("id", "last_seen_at", F.coalesce("mentions_since", F.lit(0)).alias("mentions_since")))


def resolve_products(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """vendor, product -> catalogue id by the normalised alias, else unresolved."""
    key = normalize_key(F.concat_ws(" ", F.coalesce("vendor", F.lit("")), F.col("product")))
    keyed = names.withColumn("alias_normalized", key)
    hit = aliases.select("alias_normalized", "catalog_id")
    return keyed.join(hit, "alias_normalized", "left").withColumn(
        "method", F.when(F.col("catalog_id").isNotNull(), "alias").otherwise("unresolved")
    ).withColumn("confidence", F.when(F.col("catalog_id").isNotNull(), 1.0).otherwise(0.0))


def backfill_products(candidates: DataFrame, affected: DataFrame, identifiers: DataFrame,
                      mentions: DataFrame) -> DataFrame:
    """Product rows for live candidates without any, from anchors, snippets or titles."""
    from advisorylake.functions.software import canonical_ecosystem, classify_kind

    lacking = candidates.where(F.col("merged_into").isNull()).select("id").join(
        affected.select("candidate_id").distinct(), F.col("id") == F.col("candidate_id"), "left_anti")
    commit = F.regexp_extract("value", r"^GHCOMMIT:(.*)@.*$", 1)
    by_id = identifiers.groupBy(F.col("candidate_id").alias("i_id")).agg(
        F.min(F.when(F.col("scheme") == "GHCOMMIT", commit)).alias("repo"),
        F.bool_or((F.col("scheme") == "OSV") & F.upper("value").startswith("MAL-")).alias("mal"))
    in_snippet = F.when(F.col("snippet").contains("affected:"),
                        F.regexp_extract("snippet", r"affected: (\S+)", 1))
    in_title = F.regexp_extract("title", r"^([^:]+/[^:]+):", 1)
    first = F.col("id")
    by_text = mentions.groupBy(F.col("candidate_id").alias("m_id")).agg(
        F.min_by(in_snippet, F.when(in_snippet != "", first)).alias("package"),
        F.min_by(in_title, F.when(in_title != "", first)).alias("prefix"))
    software = strip(F.coalesce("repo", "package", "prefix"))
    rows = (lacking.join(by_id, F.col("id") == F.col("i_id"), "left")
            .join(by_text, F.col("id") == F.col("m_id"), "left")
            .select("id", software.alias("s"), F.coalesce("mal", F.lit(False)).alias("mal"))
            .where(F.col("s") != ""))
    is_repo = F.col("s").contains("/") & ~F.split("s", "/")[0].contains(":")
    eco = F.regexp_extract("s", r"(?s)^([^:]*):(.+)$", 1)
    name = F.regexp_extract("s", r"(?s)^[^:]*:(.+)$", 1)
    bare_eco = F.regexp_extract("s", r"^([^:]*)", 1)
    return rows.select(
        F.col("id").alias("candidate_id"),
        F.when(is_repo, F.lower("s")).when(name != "", name).otherwise(F.col("s")).alias("product"),
        F.when(is_repo, F.lit("github")).when(name != "", canonical_ecosystem(eco)).alias("ecosystem"),
        F.when(F.col("mal"), "malware").when(is_repo, "product")
        .otherwise(classify_kind(bare_eco)).alias("kind"))
