"""The repository watch list."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.functions.dates import ts
from advisorylake.functions.repos import extract_repo

RESCAN_MIN_HOURS = 6


def three_stream_refs(mentions: DataFrame, references: DataFrame,
                      candidates: DataFrame) -> DataFrame:
    """(url, with_cve) from mention links, catalogue references and candidate lists."""
    a = mentions.where(F.col("url").isNotNull()).select(
        "url", F.coalesce(F.col("extracted_cve") != "", F.lit(False)).alias("with_cve"))
    b = references.where(F.col("url").isNotNull()).select("url", F.lit(False).alias("with_cve"))
    c = candidates.select(F.explode("reference_urls").alias("url"),
                          F.col("cve_id").isNotNull().alias("with_cve"))
    return a.unionByName(b).unionByName(c)


def harvest_references(urls: DataFrame) -> DataFrame:
    """Repositories cited anywhere; past_cve as soon as one citing row has a CVE."""
    return (urls.select(extract_repo(F.col("url")).alias("full_name"), "with_cve")
            .where(F.col("full_name").isNotNull()).groupBy("full_name")
            .agg(F.when(F.bool_or("with_cve"), "past_cve").otherwise("reference").alias("origin")))


def _queue(repos: DataFrame, mark: Column, as_of: dt.datetime, n: int) -> DataFrame:
    due = mark.isNull() | (mark < ts(as_of - dt.timedelta(hours=RESCAN_MIN_HOURS)))
    return repos.where(due).orderBy(
        F.desc("priority"), mark.asc_nulls_first(), F.desc_nulls_last("stars"),
        "full_name").limit(n)


def repo_next_batch(repos: DataFrame, as_of: dt.datetime, n: int) -> DataFrame:
    return _queue(repos, F.col("last_scanned_at"), as_of, n)


def repo_next_batch_adv(repos: DataFrame, as_of: dt.datetime, n: int) -> DataFrame:
    """Same queue on its own mark, without proof-of-concept repositories."""
    rows = repos.where(F.col("repo_kind").isNull() | (F.col("repo_kind") != "poc"))
    return _queue(rows, F.col("adv_last_scanned_at"), as_of, n)


def criticality_topn(rows: DataFrame, n: int) -> DataFrame:
    """``url`` and text ``default_score`` -> distinct repositories of the top rows."""
    score = F.coalesce(F.col("default_score").try_cast("double"), F.lit(0.0))
    ranked = rows.withColumn("score", score).orderBy(F.desc("score"), "url")
    top = ranked.limit(n) if n > 0 else ranked
    return (top.select(extract_repo(F.col("url")).alias("full_name"), "score")
            .where(F.col("full_name").isNotNull()).groupBy("full_name")
            .agg(F.max("score").alias("score")))
