"""Per-candidate aggregates over mentions and best-of-group picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def candidate_aggregates(mentions: DataFrame) -> DataFrame:
    """mention_count, source_count and the seen range, in two reducing steps.

    The first step groups by (candidate, source), which spreads a hot candidate over its
    sources; the second sees at most one row per source.
    """
    per_source = mentions.groupBy("candidate_id", "source_id").agg(
        F.count("*").alias("n"), F.min("seen_at").alias("lo"), F.max("seen_at").alias("hi"))
    return per_source.groupBy("candidate_id").agg(
        F.sum("n").alias("mention_count"), F.count("source_id").alias("source_count"),
        F.min("lo").alias("first_seen_at"), F.max("hi").alias("last_seen_at"))


def refresh_candidates(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidates with fresh aggregates; a candidate with a mention is emerging."""
    fresh = candidate_aggregates(mentions).withColumnsRenamed(
        {"candidate_id": "agg_id", "first_seen_at": "agg_first", "last_seen_at": "agg_last"})
    joined = candidates.drop("mention_count", "source_count").join(
        fresh, F.col("id") == F.col("agg_id"), "left")
    return joined.withColumns({
        "mention_count": F.coalesce("mention_count", F.lit(0)),
        "source_count": F.coalesce("source_count", F.lit(0)),
        "first_seen_at": F.coalesce("agg_first", "first_seen_at"),
        "last_seen_at": F.coalesce("agg_last", "last_seen_at"),
        "status": F.when((F.col("status") == "candidate")
                         & (F.coalesce("mention_count", F.lit(0)) >= 1), "emerging")
        .otherwise(F.col("status")),
    }).drop("agg_id", "agg_first", "agg_last")


def epss_current(epss: DataFrame) -> DataFrame:
    """Latest score per CVE; max_by keeps one buffer per key instead of sorting history."""
    value = F.struct(*[c for c in epss.columns if c != "cve_id"])
    best = epss.groupBy("cve_id").agg(F.max_by(value, "scored_date").alias("row"))
    return best.select("cve_id", "row.*")


def cvss_selected(cvss: DataFrame) -> DataFrame:
    """Best row per candidate: scored, then authoritative, then version, then score.

    A row without a score is selected only where no row has one.
    """
    rank = F.struct(
        F.col("base_score").isNotNull().alias("scored"),
        (F.col("provenance") == "authoritative").alias("authoritative"),
        F.when(F.col("version") == "4.0", 3).when(F.col("version") == "3.1", 2).otherwise(1)
        .alias("version_rank"),
        F.col("base_score").alias("score"),
        F.col("version").alias("tie"),
    )
    value = F.struct(*[c for c in cvss.columns if c != "candidate_id"])
    best = cvss.groupBy("candidate_id").agg(F.max_by(value, rank).alias("row"))
    return best.select("candidate_id", "row.*")


def max_cvss(cvss: DataFrame) -> DataFrame:
    return cvss.groupBy("candidate_id").agg(F.max("base_score").alias("cvss"))


def min_tier(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    from advisorylake.operators.predicates import candidate_sources

    return candidate_sources(mentions, sources).groupBy("candidate_id").agg(
        F.min("tier").alias("min_tier"))


def first_product(affected: DataFrame) -> DataFrame:
    """Alphabetically first product that is not malware."""
    good = affected.where(F.col("kind").isNull() | (F.col("kind") != "malware"))
    return good.groupBy("candidate_id").agg(F.min("product").alias("product"))


def source_names(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """Comma-joined distinct source names; at most one entry per registered source."""
    from advisorylake.operators.predicates import candidate_sources

    names = candidate_sources(mentions, sources).select("candidate_id", "source").distinct()
    return names.groupBy("candidate_id").agg(
        F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def member_rank() -> Column:
    """Order in which candidates of a component win: has a CVE, then seen first (unknown
    dates last), then smallest id. Every merge rule uses this one."""
    return F.struct(F.col("cve_id").isNull().alias("no_cve"),
                    F.col("first_seen_at").isNull().alias("undated"),
                    F.col("first_seen_at"), F.col("id"))


def merge_winner(members: DataFrame) -> DataFrame:
    return members.groupBy("component").agg(F.min_by("id", member_rank()).alias("winner"))


def earliest_candidate(candidates: DataFrame) -> DataFrame:
    """One live candidate per CVE, oldest first."""
    live = candidates.where(F.col("merged_into").isNull() & F.col("cve_id").isNotNull())
    rank = F.struct(F.col("first_seen_at").isNull().alias("undated"), F.col("first_seen_at"),
                    F.col("id"))
    return live.groupBy("cve_id").agg(F.min_by("id", rank).alias("id"))


def timeline_last(mentions: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Newest ``limit`` mentions per candidate with their ascending position.

    The rank filter becomes a group limit that prunes on the map side; one candidate
    never ships more than ``limit`` rows per map task.
    """
    newest = W.partitionBy("candidate_id").orderBy(
        F.desc("seen_at"), *[F.desc(c) for c in order])
    oldest = W.partitionBy("candidate_id").orderBy("seen_at", *order)
    return (mentions.withColumn("rn", F.row_number().over(newest))
            .where(F.col("rn") <= limit).drop("rn")
            .withColumn("position", F.row_number().over(oldest)))


def snippets_topk(mentions: DataFrame, k: int = 40) -> DataFrame:
    """First ``k`` distinct "title snippet" pieces per candidate in mention order."""
    piece = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "snippet")])
    first_use = (
        mentions.select("candidate_id", "id", piece.alias("piece")).where(F.col("piece") != "")
        .groupBy("candidate_id", "piece").agg(F.min("id").alias("first_id")))
    order = W.partitionBy("candidate_id").orderBy("first_id", "piece")
    return (first_use.withColumn("position", F.row_number().over(order))
            .where(F.col("position") <= k)
            .select("candidate_id", "position", "piece"))


def candidate_text(mentions: DataFrame, k: int = 40) -> DataFrame:
    """Those pieces as one text; bounded by ``k`` pieces per candidate."""
    rows = snippets_topk(mentions, k).groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("parts"))
    return rows.select(
        "candidate_id",
        F.array_join(F.transform("parts", lambda x: x["piece"]), "\n").alias("text"))
