"""The official catalogue, NVD pages and EPSS scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from advisorylake.functions.dates import parse_iso, ts
from advisorylake.functions.text import first_of

_CVE_META = (
    "cveMetadata struct<cveId:string,state:string,datePublished:string,dateUpdated:string,"
    "assignerShortName:string>, containers struct<cna:struct<providerMetadata:"
    "struct<shortName:string>>>")


def without_nul(raw):
    """Drop NUL characters, written raw or as an (unescaped) JSON escape."""
    bare = F.translate(raw, "\u0000", "")
    return F.regexp_replace(bare, r"(?<!\\)((?:\\\\)*)\\u0000", "$1")


def scan_cvelist(documents: DataFrame) -> DataFrame:
    """raw CVE 5 records -> catalogue columns; records without an id are skipped."""
    clean = documents.select(without_nul(F.col("raw")).alias("raw"))
    rows = clean.select("raw", F.from_json("raw", _CVE_META).alias("r"))
    meta = F.col("r.cveMetadata")
    assigner = meta["assignerShortName"]
    return rows.where(meta["cveId"] != "").select(
        meta["cveId"].alias("id"), meta["state"].alias("state"),
        parse_iso(meta["datePublished"]).alias("cvelist_published_at"),
        parse_iso(meta["dateUpdated"]).alias("cvelist_updated_at"),
        assigner.alias("assigner_short_name"),
        first_of(assigner, F.col("r.containers.cna.providerMetadata.shortName")).alias("cna"),
        F.col("raw").alias("raw_json"))


def changed_files(files: DataFrame, processed: DataFrame, force_full: bool = False) -> DataFrame:
    """Files that are new or modified since they were processed.

    ``files`` and ``processed`` carry path and modified_at. A mirror without catalogue
    rows or an unfinished full import must pass ``force_full``.
    """
    if force_full:
        return files
    return files.join(processed.select("path", "modified_at"), ["path", "modified_at"], "left_anti")


def needs_full_import(published: DataFrame, full_import_complete: bool) -> bool:
    """A cursor never outranks the data: an empty mirror is imported whole."""
    return not full_import_complete or published.where(
        F.col("cvelist_updated_at").isNotNull()).isEmpty()


_NVD_CVE = "struct<id:string,published:string,lastModified:string,vulnStatus:string>"


def scan_nvd(pages: DataFrame) -> DataFrame:
    """raw pages with ``vulnerabilities[]``, wrapped in ``cve`` or bare."""
    item = f"struct<cve:{_NVD_CVE},id:string,published:string,lastModified:string,vulnStatus:string>"
    v = pages.select(F.explode(F.from_json("raw", f"vulnerabilities array<{item}>")
                               ["vulnerabilities"]).alias("v"))
    bare = F.struct("v.id", "v.published", "v.lastModified", "v.vulnStatus")
    cve = v.select(F.coalesce(F.col("v.cve"), bare).alias("c"))
    return cve.select(
        F.col("c.id").alias("id"), parse_iso(F.col("c.published")).alias("nvd_published_at"),
        parse_iso(F.col("c.lastModified")).alias("nvd_last_modified_at"),
        F.col("c.vulnStatus").alias("nvd_vuln_status"))


def scan_epss_csv(lines: DataFrame) -> DataFrame:
    """Lines (``raw``, ``file``) of daily score files -> score rows.

    The comment line carries the model version and the date, which is part of the key: a
    file without a date fails the job instead of being dated by guess.
    """
    text = F.trim("raw")
    heads = lines.where(text.startswith("#")).groupBy("file").agg(
        F.max(F.trim(F.regexp_extract("raw", r"model_version:([^,]*)", 1))).alias("model_version"),
        F.max(F.regexp_extract("raw", r"score_date:(\d{4}-\d{2}-\d{2})", 1)).alias("score_date"))
    cols = F.split(text, ",")
    rows = lines.where((text != "") & ~text.startswith("#")).select(
        "file", F.get(cols, 0).alias("cve_id"), F.get(cols, 1).try_cast("double").alias("score"),
        F.get(cols, 2).try_cast("double").alias("percentile"))
    # The column header and short or bad rows have no numbers.
    scored = rows.where(F.col("score").isNotNull() & F.col("percentile").isNotNull())
    # One file may hold most of the lines; its single head row is joined without
    # gathering them.
    dated = scored.join(heads, "file", "left")
    date = F.when(F.coalesce("score_date", F.lit("")) == "", F.raise_error(
        F.concat(F.lit("no score_date in the header of "), F.col("file")))).otherwise(
        F.col("score_date"))
    return dated.select("cve_id", date.cast("date").alias("scored_date"), "score", "percentile",
                        "model_version")


def scan_epss_json(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode(F.from_json(
        "raw", "data array<struct<cve:string,epss:string,percentile:string,date:string>>")
        ["data"]).alias("d"))
    return rows.select(
        F.col("d.cve").alias("cve_id"), parse_iso(F.col("d.date")).cast("date").alias("scored_date"),
        F.col("d.epss").try_cast("double").alias("score"),
        F.col("d.percentile").try_cast("double").alias("percentile"))


def cursor_overlap(rows: DataFrame, column: str, cursor: dt.datetime | None,
                   overlap: dt.timedelta, bootstrap: dt.datetime | None = None) -> DataFrame:
    """Rows to read again: a little before the cursor, or the first window without one.

    Reading twice is safe because every sink is an idempotent upsert.
    """
    if cursor is not None:
        return rows.where(F.col(column) >= ts(cursor - overlap))
    return rows if bootstrap is None else rows.where(F.col(column) >= ts(bootstrap))
