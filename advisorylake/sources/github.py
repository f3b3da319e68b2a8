"""Hosted advisories, per-repository advisories and releases, and commit logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from advisorylake.functions.dates import parse_advisory_date, parse_iso, ts
from advisorylake.functions.text import blank_to_null, empty_to_null, find_all, first_of, sorted_cves, strip
from advisorylake.sources.base import affected_item, mentions_frame, snippet_of, title_of

_PACKAGES = ("vulnerabilities:array<struct<package:struct<ecosystem:string,name:string>,"
             "vulnerable_version_range:string>>")
_ADVISORY = (f"struct<ghsa_id:string,cve_id:string,summary:string,html_url:string,"
             f"published_at:string,updated_at:string,{_PACKAGES},"
             "cwes:array<struct<cwe_id:string>>>")
_RELEASE = ("struct<name:string,body:string,tag_name:string,html_url:string,"
            "published_at:string,created_at:string>")
# Fixed value: wording of a security fix.
SECURITY_FIX = (
    r"(?i)\b(?:security fix|vulnerabilit|remote code execution|\brce\b|\bxss\b|sql injection|sqli"
    r"|auth(?:entication)? bypass|\bssrf\b|deserializ|path traversal|arbitrary (?:code|file)"
    r"|buffer overflow|use[- ]after[- ]free|privilege escalation|out[- ]of[- ]bounds)\b")
_LOG_CVE = r"(?i)CVE-\d{4}-\d{4,7}"
RECORD_END, FIELD = "\x1e", "\x1f"


def scan_ghsa(pages: DataFrame) -> DataFrame:
    """raw JSON arrays of the global advisory list."""
    a = pages.select(F.explode(F.from_json("raw", f"array<{_ADVISORY}>")).alias("a")).select("a.*")
    named = F.filter("vulnerabilities", lambda v: v["package"]["name"] != "")
    labels = F.transform(named, lambda v: strip(F.concat(
        F.coalesce(v["package"]["ecosystem"], F.lit("None")), F.lit(":"), v["package"]["name"],
        F.lit(" "), F.coalesce(v["vulnerable_version_range"], F.lit("")))))
    summary = F.coalesce("summary", F.lit(""))
    snippet = F.when(F.size(named) > 0, F.concat(
        summary, F.lit(" | affected: "), F.array_join(F.slice(labels, 1, 10), ", "))
    ).otherwise(summary)
    return mentions_frame(
        a, url=F.col("html_url"), title=title_of(summary, F.col("cve_id"), F.col("ghsa_id")),
        snippet=snippet_of(snippet), cve_id=F.col("cve_id"), native_id=F.col("ghsa_id"),
        seen_at=F.coalesce(parse_advisory_date(F.col("published_at")),
                           parse_advisory_date(F.col("updated_at"))))


def _repo(full: Column) -> Column:
    return F.when(full.contains("/"), F.regexp_extract(full, "(?s)^[^/]*/(.*)$", 1)).otherwise(full)


def _owner(full: Column) -> Column:
    return blank_to_null(F.regexp_extract(full, "^([^/]*)", 1))


def _own_product(full: Column) -> Column:
    return F.array(affected_item(product=first_of(_repo(full), full), vendor=_owner(full),
                                 kind=F.lit("product")))


def scan_repo_advisories(pages: DataFrame) -> DataFrame:
    """full_name, raw JSON array -> mentions anchored on the CVE, else on the GHSA id."""
    a = pages.select("full_name", F.explode(F.from_json("raw", f"array<{_ADVISORY}>")).alias("a")
                     ).select("full_name", "a.*")
    cve, ghsa = blank_to_null(F.col("cve_id")), blank_to_null(F.col("ghsa_id"))
    a = a.where(F.coalesce(cve, ghsa).isNotNull())
    summary = F.coalesce(strip(F.col("summary")), F.lit(""))
    named = F.filter("vulnerabilities", lambda v: v["package"]["name"] != "")
    packages = F.transform(named, lambda v: affected_item(
        product=v["package"]["name"], ecosystem=blank_to_null(v["package"]["ecosystem"]),
        kind=F.lit("product")))
    url = F.col("html_url")
    cwes = F.filter(F.transform("cwes", lambda c: c["cwe_id"]), lambda c: c != "")
    return mentions_frame(
        a, carry=["full_name"], url=url, title=title_of(summary, cve, ghsa),
        snippet=snippet_of(F.concat(F.lit("[repo advisory "), F.col("full_name"), F.lit("] "), summary)),
        cve_id=cve, native_id=F.when(cve.isNull(), ghsa),
        extra_ids=F.when(cve.isNotNull() & ghsa.isNotNull(), F.array(ghsa)),
        seen_at=F.coalesce(parse_advisory_date(F.col("published_at")),
                           parse_advisory_date(F.col("updated_at"))),
        affected=F.coalesce(empty_to_null(packages), _own_product(F.col("full_name"))),
        reference_urls=F.when(url != "", F.array(url)), cwe_ids=empty_to_null(cwes))


def scan_releases(pages: DataFrame) -> DataFrame:
    """full_name, raw JSON array of releases -> one mention per cited CVE."""
    r = pages.select("full_name", F.explode(F.from_json("raw", f"array<{_RELEASE}>")).alias("r")
                     ).select("full_name", "r.*")
    blank = F.lit("")
    body = F.concat(F.coalesce("name", blank), F.lit("\n"), F.coalesce("body", blank))
    r = r.select("*", F.explode(sorted_cves(body)).alias("cve"))
    full, url = F.col("full_name"), F.col("html_url")
    tag = F.coalesce(first_of(F.col("tag_name"), F.col("name")), blank)
    return mentions_frame(
        r, carry=["full_name"], url=url,
        title=F.left(F.concat(full, F.lit(" "), tag, F.lit(": "), F.col("cve")), F.lit(200)),
        snippet=snippet_of(F.concat(F.lit("[release "), full, F.lit(" "), tag, F.lit("] cita "),
                                    F.col("cve"))),
        cve_id=F.col("cve"),
        seen_at=F.coalesce(parse_advisory_date(F.col("published_at")),
                           parse_advisory_date(F.col("created_at"))),
        affected=_own_product(full), reference_urls=F.when(url != "", F.array(url)))


def repo_emit_filter(items: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """``seen_at`` against the repository's ``watermark``: newer than it, or inside the
    first window when there is none; undated items only on the first scan."""
    seen, mark = F.col("seen_at"), F.col("watermark")
    return items.where(
        F.when(seen.isNull(), mark.isNull()).when(mark.isNotNull(), seen > mark)
        .otherwise(seen >= ts(cutoff)))


def read_gitlogs(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit record; the record mark is the line separator, so a long log is
    split over tasks. The repository name is the file name with ``__`` for the slash."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.log$", "")
    return spark.read.option("lineSep", RECORD_END).text(path).select(
        F.replace(name, F.lit("__"), F.lit("/")).alias("full_name"), F.col("value").alias("record"))


def split_gitlog(logs: DataFrame) -> DataFrame:
    """full_name, raw whole log -> full_name, record."""
    return logs.select("full_name", F.explode(F.split("raw", RECORD_END)).alias("record"))


def _commits(records: DataFrame) -> DataFrame:
    """Fields of well-formed records."""
    parts = F.split(F.regexp_replace("record", r"^\n+|\n+$", ""), FIELD)
    rows = records.select("full_name", "record", parts.alias("p")).where(F.size("p") >= 3)
    return rows.select("full_name", "record", F.get("p", F.lit(0)).alias("sha"),
                       parse_iso(F.get("p", F.lit(1))).alias("committed_at"),
                       F.get("p", F.lit(2)).alias("msg"))


def scan_gitlog(records: DataFrame, synthesize: bool = False) -> DataFrame:
    """One mention per distinct CVE of a commit message.

    With ``synthesize`` a security fix without a CVE is anchored on the commit itself.
    """
    c = _commits(records)
    cves = F.array_distinct(F.transform(find_all(F.col("msg"), _LOG_CVE), F.upper))
    anchors = cves
    if synthesize:
        fix = (F.size(cves) == 0) & F.col("msg").rlike(SECURITY_FIX)
        anchors = F.when(fix, F.array(F.lit(""))).otherwise(cves)
    c = c.select("*", F.explode(anchors).alias("cve"))
    full, msg = F.col("full_name"), F.col("msg")
    commit = F.concat(F.lit("GHCOMMIT:"), full, F.lit("@"), F.left("sha", F.lit(12)))
    first_line = F.regexp_extract(msg, r"^([^\r\n]*)", 1)
    return mentions_frame(
        c, carry=["full_name", "sha"],
        url=F.concat(F.lit("https://github.com/"), full, F.lit("/commit/"), F.col("sha")),
        title=F.left(F.concat(full, F.lit(": "), first_line), F.lit(200)),
        snippet=snippet_of(F.concat(F.lit("["), full, F.lit("] "), msg)),
        cve_id=blank_to_null(F.col("cve")), native_id=F.when(F.col("cve") == "", commit),
        seen_at=F.col("committed_at"))


def gitlog_watermarks(records: DataFrame) -> DataFrame:
    """Newest commit per repository, compared as instants, relevant or not."""
    return _commits(records).groupBy("full_name").agg(F.max("committed_at").alias("watermark"))


def gitlog_merge_cache(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached records plus the relevant new ones; the first record of a commit stays.

    A window without relevant commits leaves the cache as it is.
    """
    def keyed(df: DataFrame, order: int) -> DataFrame:
        sha = F.regexp_extract(F.regexp_replace("record", r"^\n+", ""), r"^([^\x1f]*)", 1)
        return df.select("full_name", sha.alias("sha"), "record", F.lit(order).alias("age"))

    relevant = fresh.where(F.col("record").rlike(_LOG_CVE) | F.col("record").rlike(SECURITY_FIX))
    first = W.partitionBy("full_name", "sha").orderBy("age", "record")
    return (keyed(cached, 0).unionByName(keyed(relevant, 1))
            .withColumn("rn", F.row_number().over(first)).where("rn = 1")
            .select("full_name", "sha", "record"))


def scan_single_repo(records: DataFrame, full_name: str, as_of: dt.datetime, months: int,
                     watermark: dt.datetime | None = None) -> DataFrame:
    """The commits of one fixed repository since its watermark or the first window.

    The log is taken by day, as the watermark names the day to resume from.
    """
    start = as_of - dt.timedelta(days=30 * months)
    if watermark is not None:
        start = max(start, watermark)
    day = start.replace(hour=0, minute=0, second=0, microsecond=0)
    rows = scan_gitlog(records.where(F.col("full_name") == full_name))
    return rows.where(F.col("seen_at") >= ts(day))
