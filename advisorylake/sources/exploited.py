"""Known-exploited lists, exploit archives and proof-of-concept indexes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.functions.dates import parse_advisory_date, parse_iso, ts
from advisorylake.functions.text import (
    CVE_LOOSE, blank_to_null, empty_to_null, find_all, first_of, join_present, sorted_cves, strip,
)
from advisorylake.operators.stages import compute_once
from advisorylake.sources.base import (
    REFERENCE_CAP, affected_item, flags_of, mentions_frame, snippet_of, title_of,
)

EXPLOIT_WINDOW_DAYS = 120
_KEV = ("array<struct<cveID:string,dateAdded:string,vendorProject:string,product:string,"
        "vulnerabilityName:string,shortDescription:string,knownRansomwareCampaignUse:string>>")
_VULNCHECK = (
    "array<struct<cve:array<string>,date_added:string,vendorProject:string,product:string,"
    "vulnerabilityName:string,name:string,shortDescription:string,description:string,"
    "knownRansomwareCampaignUse:string,cwes:array<string>,"
    "vulncheck_xdb:array<struct<xdb_url:string,clone_ssh_url:string>>,"
    "vulncheck_reported_exploitation:array<struct<url:string,date_added:string>>>>")


def _nvd_url(cve: Column) -> Column:
    return F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), cve)


def scan_cisa_kev(pages: DataFrame) -> DataFrame:
    v = pages.select(F.explode(F.from_json("raw", f"vulnerabilities {_KEV}")
                               ["vulnerabilities"]).alias("v")).select("v.*")
    v = v.where(F.col("cveID") != "")
    ransom = F.when(F.col("knownRansomwareCampaignUse") != "",
                    F.concat(F.lit("ransomware="), F.col("knownRansomwareCampaignUse")))
    text = join_present(" | ", F.col("vendorProject"), F.col("product"),
                        F.col("vulnerabilityName"), ransom, F.col("shortDescription"))
    seen = parse_iso(F.col("dateAdded"))
    name = first_of(F.col("vulnerabilityName"), F.col("cveID"))
    return mentions_frame(
        v, url=_nvd_url(F.col("cveID")), title=F.left(F.concat(F.lit("KEV: "), name), F.lit(200)),
        snippet=snippet_of(text), cve_id=F.col("cveID"), seen_at=seen,
        flags=flags_of(in_kev=F.lit(True), kev_date=seen.cast("date"), kev_source=F.lit("cisa")))


def scan_vulncheck_kev(pages: DataFrame) -> DataFrame:
    """One mention per CVE; dated by the earliest of its own and reported exploitation."""
    v = pages.select(F.explode(F.from_json("raw", f"data {_VULNCHECK}")["data"]).alias("v")
                     ).select("v.*")
    reports, xdb = F.col("vulncheck_reported_exploitation"), F.col("vulncheck_xdb")
    dates = F.concat(F.array("date_added"), F.coalesce(
        F.transform(reports, lambda r: r["date_added"]), F.array().cast("array<string>")))
    first = F.array_min(F.filter(F.transform(dates, parse_advisory_date), lambda d: d.isNotNull()))
    none = F.array().cast("array<string>")
    repo = r"^git@github\.com:([\w.-]+/[\w.-]+?)(?:\.git)?$"

    def links(x: Column) -> Column:
        path = F.regexp_extract(F.coalesce(x["clone_ssh_url"], F.lit("")), repo, 1)
        return F.array(x["xdb_url"], F.when(path != "", F.concat(F.lit("https://github.com/"), path)))

    urls = F.concat(F.coalesce(F.flatten(F.transform(xdb, links)), none),
                    F.coalesce(F.transform(reports, lambda r: r["url"]), none))
    refs = F.slice(F.array_distinct(F.filter(urls, lambda u: u != "")), 1, REFERENCE_CAP)
    name = first_of(F.col("vulnerabilityName"), F.col("name"), F.col("product"),
                    F.get("cve", F.lit(0)))
    ransom = F.col("knownRansomwareCampaignUse")
    text = join_present(
        " | ", F.col("vendorProject"), F.col("product"),
        first_of(F.col("shortDescription"), F.col("description")),
        F.when((ransom != "") & (ransom != "Unknown"), F.concat(F.lit("ransomware="), ransom)))
    product = blank_to_null(F.col("product"))
    v = v.select("*", F.explode("cve").alias("one"))
    return mentions_frame(
        v, url=_nvd_url(F.col("one")),
        title=F.left(F.concat(F.lit("VulnCheck KEV: "), F.coalesce(name, F.lit("None"))), F.lit(200)),
        snippet=snippet_of(text), cve_id=F.col("one"), seen_at=first,
        flags=flags_of(in_kev=F.lit(True), kev_date=first.cast("date"),
                       kev_source=F.lit("vulncheck"),
                       has_public_poc=F.when(F.size(F.coalesce(xdb, F.array().cast(
                           "array<struct<xdb_url:string,clone_ssh_url:string>>"))) > 0, F.lit(True))),
        affected=F.when(product.isNotNull(), F.array(affected_item(
            product=product, vendor=F.col("vendorProject")))),
        cwe_ids=empty_to_null(F.filter("cwes", lambda c: c.isNotNull())),
        reference_urls=empty_to_null(refs))


def read_exploit_csv(spark, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("escape", '"').option(
        "multiLine", "true").csv(path)


def scan_exploitdb(rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Archive rows that cite CVEs, recent or undated; one mention per CVE."""
    def day(c: str) -> Column:
        return F.left(strip(F.col(c)), F.lit(10)).try_cast("date").cast("timestamp")

    blank = F.lit("")
    seen = F.coalesce(day("date_added"), day("date_published"))
    cutoff = ts(as_of - dt.timedelta(days=EXPLOIT_WINDOW_DAYS))
    e = rows.withColumn("seen", seen).where(F.col("seen").isNull() | (F.col("seen") >= cutoff))
    e = e.select("*", F.explode(sorted_cves(F.coalesce("codes", blank))).alias("cve"))
    exploit = F.coalesce(strip(F.col("id")), blank)
    title = F.left(F.coalesce(strip(F.col("description")), blank), F.lit(200))
    fallback = F.when(exploit != "", F.concat(
        F.lit("https://www.exploit-db.com/exploits/"), exploit))
    text = F.concat(F.lit("Exploit-DB #"), exploit, F.lit(" ["),
                    F.coalesce(strip(F.col("type")), blank), F.lit("] "), title,
                    F.lit(" | codes: "), F.coalesce("codes", blank))
    return mentions_frame(
        e, url=first_of(strip(F.col("source_url")), fallback),
        title=title_of(title, F.concat(F.lit("Exploit-DB #"), exploit)),
        snippet=snippet_of(text), cve_id=F.col("cve"), seen_at=F.col("seen"),
        flags=flags_of(has_public_poc=F.lit(True)))


def file_cve(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.upper(name), f"({CVE_LOOSE})", 1))


def scan_poc_index_json(documents: DataFrame) -> DataFrame:
    """file_name, raw repository list; the file name holds the CVE."""
    d = compute_once(documents.select(file_cve(F.col("file_name")).alias("cve"), "raw").where("cve IS NOT NULL"), repos=F.from_json(
        "raw", "array<struct<html_url:string,description:string,created_at:string>>")).where(F.size("repos") > 0)

    def column(name: str) -> Column:
        return F.filter(F.transform("repos", lambda r: r[name]), lambda x: x != "")

    dates = F.filter(F.transform(F.transform("repos", lambda r: r["created_at"]),
                                 parse_advisory_date), lambda t: t.isNotNull())
    d = compute_once(d, urls=column("html_url"), notes=column("description"), seen=F.array_min(dates))
    urls, notes = F.col("urls"), F.col("notes")
    title = F.concat(F.lit("PoC público: "), F.col("cve"), F.lit(" ("),
                     F.size(urls).cast("string"), F.lit(" repos)"))
    return mentions_frame(
        d, url=F.get(urls, F.lit(0)), title=F.left(title, F.lit(200)),
        snippet=F.get(notes, F.lit(0)), cve_id=F.col("cve"), seen_at=F.col("seen"),
        flags=flags_of(has_public_poc=F.lit(True)),
        reference_urls=empty_to_null(F.slice(urls, 1, REFERENCE_CAP)))


def scan_poc_index_md(documents: DataFrame) -> DataFrame:
    """file_name, raw Markdown; the product sits percent-encoded in a badge URL."""
    d = documents.select(file_cve(F.col("file_name")).alias("cve"), "raw").where(
        F.col("cve").isNotNull())
    urls = F.slice(F.array_distinct(find_all(
        F.col("raw"), r"https://github\.com/[\w.-]+/[\w.-]+")), 1, REFERENCE_CAP)
    badge = F.regexp_extract("raw", r"label=Product&message=([^&]+)", 1)
    # A plus sign is literal in this encoding.
    safe = F.regexp_replace(F.replace(badge, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    product = blank_to_null(strip(F.try_url_decode(safe)))
    return mentions_frame(
        d, url=F.get(urls, F.lit(0)),
        title=F.concat(F.col("cve"), F.coalesce(F.concat(F.lit(": "), product), F.lit(""))),
        snippet=F.concat(F.lit("trickest PoC index | product="), product), cve_id=F.col("cve"),
        flags=flags_of(has_public_poc=F.lit(True)), reference_urls=empty_to_null(urls))
