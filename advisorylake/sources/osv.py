"""Package-ecosystem advisories: one JSON record per advisory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from advisorylake.functions.dates import parse_advisory_date, ts
from advisorylake.functions.software import classify_kind, osv_ranges
from advisorylake.functions.text import empty_to_null, first_of
from advisorylake.operators.stages import compute_once
from advisorylake.sources.base import affected_item, mentions_frame, snippet_of, title_of

OVERLAP = dt.timedelta(minutes=5)
_EVENT = "struct<introduced:string,fixed:string,last_affected:string>"
_SEVERITY = "array<struct<type:string,score:string>>"
RECORD = (
    f"id string, aliases array<string>, summary string, details string, published string, "
    f"modified string, withdrawn string, severity {_SEVERITY}, "
    f"affected array<struct<package:struct<ecosystem:string,name:string,purl:string>,"
    f"severity:{_SEVERITY},ranges:array<struct<type:string,events:array<{_EVENT}>>>,"
    "versions:array<string>,database_specific:struct<informational:string>>>, "
    "database_specific struct<informational:string,cwe_ids:array<string>,cwes:array<string>>, "
    "references array<struct<url:string>>")
_MALWARE_TITLE = r"(?i)^\s*malicious (?:package|code)"


def parse_osv(documents: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """raw -> record fields (all, or the named ones), with ``modified_at`` and ``seen`` ready for the filters."""
    carry = [c for c in documents.columns if c != "raw"]
    record = T.StructType.fromDDL(RECORD)
    if fields is not None:
        record = T.StructType([f for f in record if f.name in {*fields, "published", "modified"}])
    rows = compute_once(documents, r=F.from_json("raw", record)).select(*carry, "r.*")
    dated = compute_once(rows, published_day=parse_advisory_date(F.col("published")), modified_day=parse_advisory_date(F.col("modified")))
    return dated.withColumns({"modified_at": F.coalesce("modified_day", "published_day"),
                              "seen": F.coalesce("published_day", "modified_day")}).drop("published_day", "modified_day")


def osv_cursor_filter(records: DataFrame, cursor: dt.datetime | None,
                      bootstrap: dt.datetime | None = None) -> DataFrame:
    """With a cursor: changed since shortly before it. Without: published in the window."""
    if cursor is not None:
        return records.where(F.col("modified_at") >= ts(cursor - OVERLAP))
    if bootstrap is None:
        return records
    return records.where(F.col("seen").isNull() | (F.col("seen") >= ts(bootstrap)))


def osv_relevant(records: DataFrame) -> DataFrame:
    """Records with an identifier that are no mere notices."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    cve = F.upper(F.try_element_at(_starts(aliases, "CVE-"), F.lit(1)))
    notice = _set(F.col("database_specific.informational")) | F.coalesce(
        F.exists("affected", lambda a: _set(a["database_specific"]["informational"])), F.lit(False))
    return records.where((F.coalesce(cve, F.col("id")) != "") & ~notice)


def osv_cap_topn(records: DataFrame, cap: int | None = None) -> DataFrame:
    """The ``cap`` most recently modified records per ecosystem; none or 0 keeps all.

    Notices do not use up places. Only the ranking columns decide, and the rank limit
    prunes before the shuffle.
    """
    records = osv_relevant(records)
    if not cap:
        return records
    recent = W.partitionBy("ecosystem").orderBy(F.desc_nulls_last("modified_at"), F.desc("id"))
    return (records.withColumn("rn", F.row_number().over(recent))
            .where(F.col("rn") <= cap).drop("rn"))


def _starts(values: Column, prefix: str) -> Column:
    return F.filter(values, lambda a: F.upper(a).startswith(prefix))


def _set(flag: Column) -> Column:
    """JSON truth of a field read as text."""
    return F.coalesce(~flag.isin("", "false", "null", "0"), F.lit(False))


def osv_mentions(records: DataFrame, carry: list[str] = ()) -> DataFrame:
    rows = records.withColumns({
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")),
        "summary": F.coalesce(first_of(F.col("summary"), F.col("details")), F.lit("")),
    })
    cve = F.upper(F.try_element_at(_starts(F.col("aliases"), "CVE-"), F.lit(1)))
    rows = osv_relevant(rows.withColumn("cve", cve))
    malware = (F.coalesce(F.upper("id").startswith("MAL-"), F.lit(False))
               | (F.size(_starts(F.col("aliases"), "MAL-")) > 0)
               | F.col("summary").rlike(_MALWARE_TITLE))
    rows = rows.withColumn("malware", malware)

    def item(a: Column) -> Column:
        package = a["package"]
        ranges = F.flatten(F.transform(
            F.coalesce(a["ranges"], F.array().cast(
                f"array<struct<type:string,events:array<{_EVENT}>>>")),
            lambda r: osv_ranges(r["events"], r["type"])))
        return affected_item(
            product=package["name"], ecosystem=package["ecosystem"], purl=package["purl"],
            kind=classify_kind(package["ecosystem"], F.col("malware")),
            exact_versions=empty_to_null(a["versions"]), ranges=ranges)

    named = F.filter("affected", lambda a: a["package"]["name"] != "")
    rows = compute_once(rows, items=F.transform(named, item))

    def label(i: Column) -> Column:
        fixed = F.get(i["ranges"], F.lit(0))["fixed"]
        bound = F.when(F.coalesce(fixed, F.lit("")) != "", F.concat(F.lit(" <"), fixed))
        return F.concat(F.coalesce(i["ecosystem"], F.lit("None")), F.lit(":"), i["product"],
                        F.coalesce(bound, F.lit("")))

    labels = F.array_join(F.slice(F.transform("items", label), 1, 10), ", ")
    others = F.filter("aliases", lambda a: ~a.eqNullSafe(F.col("cve")))
    snippet = F.concat(
        F.col("summary"),
        F.when(F.size("items") > 0, F.concat(F.lit(" | affected: "), labels)).otherwise(""),
        F.when(F.size(others) > 0, F.concat(F.lit(" | aliases: "), F.array_join(others, " ")))
        .otherwise(""))
    scores = F.concat(
        F.coalesce("severity", F.array().cast(_SEVERITY)),
        F.flatten(F.transform(F.coalesce("affected", F.array().cast(
            records.schema["affected"].dataType)),
            lambda a: F.coalesce(a["severity"], F.array().cast(_SEVERITY)))))
    vectors = F.array_distinct(F.transform(
        F.filter(scores, lambda s: s["score"].startswith("CVSS:")), lambda s: s["score"]))
    ds = F.col("database_specific")
    cwes = F.coalesce(empty_to_null(ds["cwe_ids"]), ds["cwes"])
    refs = F.filter(F.transform("references", lambda r: r["url"]), lambda u: u != "")
    return mentions_frame(
        rows, carry=carry,
        url=F.concat(F.lit("https://osv.dev/vulnerability/"), F.col("id")),
        title=title_of(F.col("summary"), F.col("cve"), F.col("id")), snippet=snippet_of(snippet),
        cve_id=F.col("cve"), native_id=F.col("id"), extra_ids=empty_to_null(others),
        seen_at=F.col("seen"), affected=empty_to_null(F.col("items")),
        cvss_vectors=empty_to_null(vectors), cwe_ids=empty_to_null(cwes),
        reference_urls=empty_to_null(refs),
        withdrawn=F.when(F.col("withdrawn") != "", F.lit(True)))


def scan_osv(documents: DataFrame, cutoff: dt.datetime | None = None,
             cap: int | None = None) -> DataFrame:
    """Mentions of a feed; a cap counts only what survives every filter."""
    carry = [c for c in documents.columns if c != "raw"]
    return osv_mentions(osv_cap_topn(osv_cursor_filter(parse_osv(documents), None, cutoff), cap), carry)
