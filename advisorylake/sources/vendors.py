"""Vendor and curated advisory feeds in JSON."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.functions.dates import parse_advisory_date, parse_iso, ts
from advisorylake.functions.software import gemnasium_ranges
from advisorylake.functions.text import blank_to_null, empty_to_null, first_of, sorted_cves, strip
from advisorylake.sources.base import (
    REFERENCE_CAP, affected_item, mentions_frame, snippet_of, title_of,
)

WORDFENCE_WINDOW_DAYS, GEMNASIUM_WINDOW_DAYS = 120, 180
_REDHAT = ("array<struct<CVE:string,bugzilla_description:string,severity:string,"
           "cvss3_scoring_vector:string,cvss_scoring_vector:string,public_date:string,"
           "resource_url:string>>")
_CISCO = ("array<struct<identifier:string,title:string,cve:string,summary:string,"
          "severity:string,firstPublished:string,url:string>>")
_WORDFENCE = ("struct<title:string,cve:string,published:string,"
              "software:array<struct<name:string,slug:string>>,references:array<string>>")
_GEMNASIUM = ("identifiers array<string>, package_slug string, title string, "
              "description string, pubdate string, date string, affected_range string, "
              "fixed_versions array<string>, urls array<string>, cwe_ids array<string>")


def _recent(seen: Column, as_of: dt.datetime, days: int) -> Column:
    return seen.isNull() | (seen >= ts(as_of - dt.timedelta(days=days)))


def scan_redhat(pages: DataFrame) -> DataFrame:
    i = pages.select(F.explode(F.from_json("raw", _REDHAT)).alias("i")).select("i.*")
    i = i.where(F.col("CVE") != "")
    text = F.coalesce("bugzilla_description", F.lit(""))
    vector = first_of(F.col("cvss3_scoring_vector"), F.col("cvss_scoring_vector"))
    snippet = F.concat(
        F.when(F.col("severity") != "", F.concat(F.lit("["), F.col("severity"), F.lit("] ")))
        .otherwise(""), text,
        F.when(vector.isNotNull(), F.concat(F.lit(" | CVSS: "), vector)).otherwise(""))
    return mentions_frame(
        i, url=F.col("resource_url"), title=title_of(text, F.col("CVE")),
        snippet=snippet_of(snippet), cve_id=F.col("CVE"), seen_at=parse_iso(F.col("public_date")))


def scan_cisco(pages: DataFrame) -> DataFrame:
    a = pages.select(F.explode(F.from_json("raw", _CISCO)).alias("a")).select("a.*")
    blank = F.lit("")
    title = F.left(F.coalesce(strip(F.col("title")), blank), F.lit(200))
    summary = F.coalesce(strip(F.col("summary")), blank)
    cited = sorted_cves(F.concat_ws(" ", F.col("cve"), F.col("summary")))
    text = F.concat(F.when(F.col("severity") != "", F.concat(
        F.lit("["), F.col("severity"), F.lit("] "))).otherwise(""), title, F.lit(" | "), summary)
    a = a.select("*", F.explode(cited).alias("one"))
    return mentions_frame(
        a, url=F.col("url"), title=title_of(title, F.col("one")), snippet=snippet_of(text),
        cve_id=F.col("one"), seen_at=parse_advisory_date(F.col("firstPublished")))


def scan_wordfence(documents: DataFrame, as_of: dt.datetime) -> DataFrame:
    """raw object keyed by id, or list, of plugin vulnerabilities.

    ``cve`` may be one value or a list; read as text, both forms hold the ids. References
    may be objects with a url.
    """
    body = F.col("raw")
    listed = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{_WORDFENCE}>"))
    keyed = F.when(F.ltrim(body).startswith("{"), F.map_values(
        F.from_json(body, f"map<string,{_WORDFENCE}>")))
    v = documents.select(F.explode(F.coalesce(listed, keyed)).alias("v")).select("v.*")
    seen = parse_advisory_date(F.col("published"))
    v = v.withColumn("seen", seen).where(_recent(F.col("seen"), as_of, WORDFENCE_WINDOW_DAYS))
    title = F.left(F.coalesce(strip(F.col("title")), F.lit("")), F.lit(200))
    names = F.filter(F.transform("software", lambda s: first_of(s["name"], s["slug"])),
                     lambda n: n.isNotNull())
    affected = F.transform(names, lambda n: affected_item(
        product=n, ecosystem=F.lit("wordpress"), kind=F.lit("product")))
    refs = F.filter(F.transform("references", lambda r: F.get_json_object(r, "$.url")),
                    lambda u: u != "")
    cves = sorted_cves(F.concat_ws(" ", F.col("cve"), F.col("title")))
    v = v.withColumn("cves", cves).select("*", F.explode("cves").alias("one"))
    return mentions_frame(
        v, url=F.get(refs, F.lit(0)), title=title_of(title, F.get("cves", F.lit(0))),
        snippet=blank_to_null(title), cve_id=F.col("one"), seen_at=F.col("seen"),
        affected=empty_to_null(affected),
        reference_urls=empty_to_null(F.slice(refs, 1, REFERENCE_CAP)))


def scan_gemnasium(documents: DataFrame, as_of: dt.datetime) -> DataFrame:
    """ecosystem, raw decoded advisory record (one JSON object per row).

    Fixed versions are stored as exact versions, as the tables expect from this feed.
    """
    d = documents.select("ecosystem", F.from_json("raw", _GEMNASIUM).alias("r")).select(
        "ecosystem", "r.*")
    seen = parse_advisory_date(first_of(F.col("pubdate"), F.col("date")))
    d = d.withColumn("seen", seen).where(_recent(F.col("seen"), as_of, GEMNASIUM_WINDOW_DAYS))
    ids = F.filter("identifiers", lambda i: i != "")
    is_cve = lambda i: F.upper(i).startswith("CVE-")
    d = d.withColumns({"cves": F.filter(ids, is_cve), "others": F.filter(ids, lambda i: ~is_cve(i))})
    d = d.where(F.size(F.concat("cves", "others")) > 0)
    slug = first_of(F.col("package_slug"), F.concat("ecosystem", F.lit("/?")))
    product = F.when(slug.contains("/"), F.regexp_extract(slug, "(?s)^[^/]*/(.*)$", 1)).otherwise(slug)
    title = F.left(F.coalesce(strip(F.col("title")), F.lit("")), F.lit(200))
    text = F.concat(title, F.lit(" | "), F.coalesce(strip(F.col("description")), F.lit("")))
    has_cve = F.size("cves") > 0
    anchor = F.when(has_cve, F.get("cves", F.lit(0))).otherwise(F.get("others", F.lit(0)))
    rest = F.when(has_cve, F.concat(F.slice("cves", 2, F.size("cves")), F.col("others"))).otherwise(
        F.slice("others", 2, F.size("others")))
    refs = F.filter("urls", lambda u: u.isNotNull())
    none = F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string,"
                          "version_type:string,raw:string>>")
    item = affected_item(
        product=product, ecosystem=F.col("ecosystem"),
        ranges=F.coalesce(gemnasium_ranges(F.col("affected_range")), none),
        exact_versions=empty_to_null(F.col("fixed_versions")))
    return mentions_frame(
        d, url=F.get(refs, F.lit(0)), title=title_of(title, anchor), snippet=snippet_of(text),
        cve_id=F.when(has_cve, anchor), native_id=F.when(~has_cve, anchor),
        extra_ids=empty_to_null(rest), seen_at=F.col("seen"), affected=F.array(item),
        reference_urls=empty_to_null(refs),
        cwe_ids=empty_to_null(F.filter("cwe_ids", lambda c: c.isNotNull())))
