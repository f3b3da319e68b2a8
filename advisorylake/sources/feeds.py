"""Feed entries, advisory pages and scraped listings.

Entry frames have title, summary, link and the raw published/updated texts or an already
typed seen_at.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from advisorylake.functions.dates import parse_advisory_date, ts
from advisorylake.functions.identifiers import extract_identifiers, primary_cve
from advisorylake.functions.text import (
    CVE_LOOSE, blank_to_null, find_all, first_of, sorted_cves, strip,
)
from advisorylake.operators.ingest import mention_fanout
from advisorylake.operators.stages import compute_once
from advisorylake.sources.base import affected_item, mentions_frame, snippet_of, title_of

ADVISORY_WINDOW_DAYS = 120
LISTING_HOST = "https://www.tenable.com"


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Landed RSS (``item``) or Atom (``entry``) files as entry rows."""
    if row_tag == "entry":
        schema = "title string, summary string, content string, published string, " \
                 "updated string, link array<struct<_href:string>>"
        e = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
        return e.select("title", first_of(F.col("summary"), F.col("content")).alias("summary"),
                        F.get("link", F.lit(0))["_href"].alias("link"),
                        parse_advisory_date(first_of(F.col("published"), F.col("updated")))
                        .alias("seen_at"))
    e = spark.read.format("xml").option("rowTag", row_tag).schema(
        "title string, description string, link string, pubDate string").load(path)
    zone = F.regexp_replace("pubDate", r"(?:GMT|UTC|Z)$", "+0000")
    return e.select("title", F.col("description").alias("summary"), "link",
                    F.try_to_timestamp(F.regexp_replace(zone, r"^[A-Za-z]{3}, ", ""),
                                       F.lit("d MMM yyyy HH:mm:ss Z")).alias("seen_at"))


def scan_feed_entries(entries: DataFrame) -> DataFrame:
    """Fan-out policy shared by all generic feeds."""
    carry = [c for c in entries.columns if c not in ("title", "summary", "link", "seen_at")]
    m = mention_fanout(entries.withColumnRenamed("link", "url"))
    return mentions_frame(m, carry=carry, url=F.col("url"), title=F.col("title"),
                          snippet=F.col("snippet"), cve_id=F.col("cve_id"),
                          native_id=F.col("native_id"), extra_ids=F.col("extra_ids"),
                          seen_at=F.col("seen_at"))


def scan_kernel_cve(entries: DataFrame) -> DataFrame:
    """Announcements "CVE: subsystem: subject"; the product is the kernel itself."""
    cve = F.regexp_extract(F.upper("title"), CVE_LOOSE, 0)
    e = entries.withColumn("cve", cve).where(F.col("cve") != "")
    subject = F.when(F.col("title").contains(":"),
                     strip(F.regexp_extract("title", r"(?s)^[^:]*:(.*)$", 1))).otherwise(F.col("title"))
    plain = F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]+>", " ")
    text = strip(F.regexp_replace(F.concat(subject, F.lit(" | "), plain), r"(?U)\s+", " "))
    return mentions_frame(
        e, url=F.col("link"), title=title_of(subject, F.col("cve")), snippet=snippet_of(text),
        cve_id=F.col("cve"), seen_at=F.col("seen_at"),
        affected=F.array(affected_item(product=F.lit("Linux Kernel"), vendor=F.lit("Linux"),
                                       kind=F.lit("product"))))


def scan_jenkins(entries: DataFrame, pages: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Recent advisory entries joined to their landed pages (link, text)."""
    cutoff = ts(as_of - dt.timedelta(days=ADVISORY_WINDOW_DAYS))
    recent = entries.where((F.col("link") != "") & (
        F.col("seen_at").isNull() | (F.col("seen_at") >= cutoff)))
    # Ids are pulled out of the page before the join, so page text is not shuffled.
    cited = pages.select("link", sorted_cves(F.col("text")).alias("cves"))
    e = recent.join(cited, "link").select("*", F.explode("cves").alias("cve"))
    title = F.coalesce("title", F.lit(""))
    return mentions_frame(
        e, url=F.col("link"),
        title=F.left(F.concat(title, F.lit(": "), F.col("cve")), F.lit(200)),
        snippet=blank_to_null(title), cve_id=F.col("cve"), seen_at=F.col("seen_at"),
        affected=F.array(affected_item(product=F.lit("Jenkins"), vendor=F.lit("Jenkins"))))


def _text_of(html: Column, gap: str) -> Column:
    """Text nodes joined by ``gap``, entities of the five reserved characters decoded."""
    nodes = F.filter(F.transform(F.split(html, "<[^>]*>"), strip), lambda t: t != "")
    out = F.array_join(nodes, gap)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def scan_plugin_listing(documents: DataFrame) -> DataFrame:
    """Table rows that link to a plugin and cite a CVE; raw is the whole page.

    Ids are read from the whole row and carried in ``whole_text_ids``, the snippet is cut.
    """
    carry = [c for c in documents.columns if c != "raw"]
    anchor = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'](/plugins/nessus/[^\"']*)[\"'][^>]*>(.*?)</a>"
    rows = documents.select(*carry, F.explode(find_all(
        F.col("raw"), r"(?is)<tr\b[^>]*>.*?</tr>")).alias("row"))
    rows = rows.select(
        *carry, F.regexp_extract("row", anchor, 1).alias("href"),
        _text_of(F.regexp_extract("row", anchor, 2), "").alias("title"),
        _text_of(F.col("row"), " ").alias("text"),
    ).where((F.col("href") != "")
            & F.upper(F.concat("text", F.lit(" "), "title")).contains("CVE-"))
    found = compute_once(rows, whole_text_ids=extract_identifiers(F.col("title"), F.col("text")))
    return mentions_frame(
        found, carry=[*carry, "whole_text_ids"], url=F.concat(F.lit(LISTING_HOST), F.col("href")),
        title=blank_to_null(F.col("title")), snippet=snippet_of(F.col("text")))


def scan_news(entries: DataFrame) -> DataFrame:
    """News that names a CVE, anchored on the first one of the whole text.

    The snippet is only a beginning of the text, so the ids are read before it is cut and
    carried in ``whole_text_ids``.
    """
    carry = [c for c in entries.columns if c not in ("title", "summary", "link", "seen_at")]
    blob = F.concat_ws(" ", F.col("title"), F.col("summary"))
    e = compute_once(entries.where(F.upper(blob).contains("CVE-")),
                     whole_text_ids=extract_identifiers(F.col("title"), F.col("summary")))
    return mentions_frame(e, carry=[*carry, "whole_text_ids"], url=F.col("link"), title=F.col("title"),
                          cve_id=primary_cve(F.col("whole_text_ids")), snippet=snippet_of(F.col("summary")),
                          seen_at=F.col("seen_at"))
