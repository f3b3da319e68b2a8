"""Source scans over raw documents that Spark derives from the driver tables.

Each query first writes the tables' rows into the source's own raw format (JSON, CSV,
Markdown, HTML, commit logs), then runs the scan on that text; the SQL twin states the
expected mentions directly over the tables.
"""

from __future__ import annotations

import datetime as dt

from advisorylake.operators import documents as DOC
from advisorylake.operators import ingest as I
from advisorylake.plans import reports as R
from advisorylake.session import cut_lineage, scratch_path
from advisorylake.sources import baseline as BL, exploited as EX, feeds as FD, github as GH
from advisorylake.sources import osv as OSV, sinks, vendors as VD
from workloads.common import Ctx, F, P, Registry

reg = Registry()
add = reg.add
UTC = dt.timezone.utc
# A clock that splits the data for window rules.
MID = dt.datetime(1998, 7, 1, tzinfo=UTC)


def s(**cols):
    return F.struct(*[(c if hasattr(c, "cast") else F.lit(c)).alias(k) for k, c in cols.items()])


def iso(c="first_seen_at", pattern="yyyy-MM-dd'T'HH:mm:ss'Z'"):
    return F.date_format(c, pattern)


def pages(df, item, wrap=None, size: int = 50, keep: list[str] = ()):
    """JSON pages of at most ``size`` items, as an API would return them."""
    rows = df.select((F.floor(F.col("id") / size)).alias("page"), *keep, item.alias("item"))
    grouped = rows.groupBy("page", *keep).agg(F.collect_list("item").alias("items"))
    body = F.to_json(F.struct(F.col("items").alias(wrap))) if wrap else F.to_json("items")
    return grouped.select(*keep, body.alias("raw"))


def joined(c):
    return F.array_join(c, " ")


def products(c="affected"):
    """Affected items as text: product/vendor/ecosystem/kind/number of ranges."""
    part = lambda a: F.concat_ws("/", *[F.coalesce(a[k], F.lit("-"))
                                        for k in ("product", "vendor", "ecosystem", "kind")],
                                 F.size(F.coalesce(a["ranges"], F.array().cast(
                                     "array<struct<introduced:string,fixed:string,"
                                     "last_affected:string,version_type:string,raw:string>>")))
                                 .cast("string"))
    return joined(F.transform(c, part)).alias("affected")


CVE = "coalesce(cve_id, 'CVE-2000-' || lpad(CAST(id AS STRING), 7, '0'))"


def cve_col():
    """The row's CVE, or a made-up one for rows without."""
    return F.coalesce("cve_id", F.concat(F.lit("CVE-2000-"), F.lpad(F.col("id").cast("string"), 7, "0")))



# ---- catalogue, NVD, EPSS ---------------------------------------------------------


def _records(c: Ctx):
    """CVE JSON 5 records with a CNA and, for even ids, one ADP container."""
    v31 = s(version="3.1", vectorString="CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
            baseScore=(F.col("id") % 100) / 10.0, baseSeverity="high")
    v40 = s(version=F.lit(None).cast("string"), vectorString="CVSS:4.0/AV:N",
            baseScore=(F.col("id") % 90) / 10.0, baseSeverity="Low")
    metric = F.array(
        F.struct(F.lit("Secondary").alias("type"), v31.alias("cvssV3_1"),
                 F.when(F.lit(False), v40).alias("cvssV4_0")),
        F.struct(F.lit("Primary").alias("type"), F.when(F.lit(False), v31).alias("cvssV3_1"),
                 F.when(F.col("id") % 3 == 0, v40).alias("cvssV4_0")))
    ssvc = F.array(F.struct(s(type="ssvc", content=F.struct(F.array(
        F.create_map(F.lit("Exploitation"), F.when(F.col("id") % 4 == 0, "active").otherwise("none")),
        F.create_map(F.lit("Technical Impact"), F.lit("total"))).alias("options"))).alias("other")))
    refs = F.array(
        s(url=F.concat(F.lit("https://a.example/"), F.col("id").cast("string")),
          tags=F.when(F.col("id") % 5 == 0, F.array(F.lit("Exploit")))),
        s(url=F.lit("https://shared.example/x"), tags=F.array(F.lit("patch"))))
    adp_refs = F.array(s(url=F.concat(F.lit("https://a.example/"), F.col("id").cast("string")),
                         tags=F.array(F.lit("patch"), F.lit("exploit"))))
    cna = F.struct(
        s(shortName=F.when(F.col("id") % 2 == 1, "acme"), orgId=F.lit("org-1")).alias("providerMetadata"),
        metric.alias("metrics"),
        F.array(F.struct(F.array(
            s(cweId=F.when(F.col("id") % 2 == 0, F.lit("cwe-79")), description=F.lit("XSS")))
            .alias("descriptions"))).alias("problemTypes"),
        F.array(s(defaultStatus=F.when(F.col("id") % 4 == 1, "unaffected"),
                  cpes=F.array(F.concat(F.lit("cpe:2.3:a:v:p"), F.col("id").cast("string")), F.lit("bad")))).alias("affected"),
        refs.alias("references"),
        F.array(s(lang="es", value="hola"), s(lang="en-US", value=F.concat(F.lit("desc \u0000 "), F.col("id").cast("string"))))
        .alias("descriptions"))
    adp = F.when(F.col("id") % 2 == 0, F.array(F.struct(
        s(shortName="CISA-ADP", orgId="x").alias("providerMetadata"), ssvc.alias("metrics"),
        adp_refs.alias("references"),
        F.array(F.struct(F.array(s(cweId="CWE-20", description="in")).alias("descriptions")))
        .alias("problemTypes"))))
    meta = s(cveId=F.col("cve_id"), state=F.when(F.col("id") % 11 == 0, "REJECTED").otherwise("PUBLISHED"),
             datePublished=iso(), dateUpdated=iso("last_seen_at"),
             assignerShortName=F.when(F.col("id") % 3 == 0, "mitre"))
    record = F.to_json(F.struct(meta.alias("cveMetadata"), F.struct(
        cna.alias("cna"), adp.alias("adp")).alias("containers")))
    return c.landed.select("cve_id", record.alias("raw"))


add("scan_cvelist",
    lambda c: BL.scan_cvelist(_records(c)).select(
        "id", "state", "cvelist_published_at", "cvelist_updated_at", "assigner_short_name", "cna",
        F.col("raw_json").contains("u0000").alias("has_nul")),
    "SELECT cve_id AS id, CASE WHEN id % 11 = 0 THEN 'REJECTED' ELSE 'PUBLISHED' END AS state, "
    "first_seen_at AS cvelist_published_at, last_seen_at AS cvelist_updated_at, "
    "CASE WHEN id % 3 = 0 THEN 'mitre' END AS assigner_short_name, "
    "CASE WHEN id % 3 = 0 THEN 'mitre' WHEN id % 2 = 1 THEN 'acme' END AS cna, FALSE AS has_nul "
    "FROM candidates WHERE cve_id IS NOT NULL")


def _files(c: Ctx, shift: int):
    return c.landed.select(
        F.concat(F.lit("cves/"), F.col("id").cast("string"), F.lit(".json")).alias("path"),
        F.when(F.col("id") % 4 == 0, F.col("last_seen_at") + F.make_dt_interval(F.lit(shift)))
        .otherwise(F.col("last_seen_at")).alias("modified_at"))


add("scan_cvelist_delta",
    lambda c: BL.changed_files(_files(c, 1), _files(c, 0).where(
        F.regexp_extract("path", r"(\d+)", 1).cast("long") % 10 != 0)),
    "SELECT 'cves/' || id || '.json' AS path, CASE WHEN id % 4 = 0 THEN last_seen_at + INTERVAL 1 DAY "
    "ELSE last_seen_at END AS modified_at FROM candidates WHERE id % 4 = 0 OR id % 10 = 0")


def _nvd_pages(c: Ctx):
    v = s(id=cve_col(), published=iso(pattern="yyyy-MM-dd'T'HH:mm:ss.SSS"), lastModified=iso("last_seen_at"),
          vulnStatus=F.when(F.col("id") % 2 == 0, "Analyzed").otherwise("Received"))
    empty = F.lit(None).cast("string")
    bare = F.struct(F.when(F.col("id") % 3 == 0, v).alias("cve"), *[
        F.when(F.col("id") % 3 != 0, v[k]).otherwise(empty).alias(k)
        for k in ("id", "published", "lastModified", "vulnStatus")])
    return pages(c.landed, bare, "vulnerabilities")


add("scan_nvd", lambda c: BL.scan_nvd(_nvd_pages(c)),
    f"SELECT {CVE} AS id, first_seen_at AS nvd_published_at, last_seen_at AS nvd_last_modified_at, "
    "CASE WHEN id % 2 = 0 THEN 'Analyzed' ELSE 'Received' END AS nvd_vuln_status FROM candidates")


def _epss_lines(c: Ctx):
    day = F.date_format("scored_date", "yyyy-MM-dd")
    name = F.concat(F.lit("epss-"), day)
    e = c.epss_scores
    heads = e.select(name.alias("file"), day.alias("d")).distinct().select("file", F.explode(F.array(
        F.concat(F.lit("#model_version:v2026,score_date:"), F.col("d"), F.lit("T00:00:00+0000")),
        F.lit("cve,epss,percentile"), F.lit("CVE-short"))).alias("raw"))
    rows = e.select(name.alias("file"), F.concat_ws(
        ",", "cve_id", F.round("score", 4).cast("string"), F.lit("0.5")).alias("raw"))
    return heads.unionByName(rows)


add("scan_epss_csv", lambda c: BL.scan_epss_csv(_epss_lines(c)),
    "SELECT cve_id, scored_date, round(score, 4) AS score, 0.5::DOUBLE AS percentile, 'v2026' AS model_version "
    "FROM epss_scores")
add("scan_epss_json",
    lambda c: BL.scan_epss_json(c.epss_scores.withColumn("id", F.abs(F.hash("cve_id"))).transform(
        lambda d: pages(d, s(cve=F.col("cve_id"), epss=F.round("score", 4).cast("string"),
                             percentile=F.lit("0.25"), date=F.date_format("scored_date", "yyyy-MM-dd")), "data"))),
    "SELECT cve_id, scored_date, round(score, 4) AS score, 0.25::DOUBLE AS percentile FROM epss_scores")

# ---- nested documents -------------------------------------------------------------


def _boxes(c: Ctx):
    return DOC.parse_records(_records(c).where("cve_id IS NOT NULL"))


_C = "FROM candidates WHERE cve_id IS NOT NULL"
_CNA = "CASE WHEN id % 2 = 1 THEN 'acme' ELSE 'org-1' END"
add("cve_containers",
    lambda c: DOC.cve_containers(_boxes(c)),
    f"SELECT cve_id, 0 AS ordinal, TRUE AS from_cna, {_CNA} AS source {_C} "
    f"UNION ALL SELECT cve_id, 1, FALSE, 'cisa-adp' {_C} AND id % 2 = 0")
add("cve_cvss",
    lambda c: DOC.cve_cvss(_boxes(c)).select("cve_id", "version", "source", "type", "vector",
                                             "base_score", "base_severity"),
    f"SELECT cve_id, '3.1' AS version, {_CNA} AS source, 'Secondary' AS type, "
    "'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' AS vector, (id % 100) / 10.0 AS base_score, "
    f"'HIGH' AS base_severity {_C} UNION ALL SELECT cve_id, '4.0', {_CNA}, 'Primary', 'CVSS:4.0/AV:N', "
    f"(id % 90) / 10.0, 'LOW' {_C} AND id % 3 = 0")
add("cve_cwe",
    lambda c: DOC.cve_cwe(_boxes(c)).select("cve_id", "cwe_id", "description", "source"),
    "SELECT cve_id, CASE WHEN id % 2 = 0 THEN 'cwe-79' ELSE 'XSS' END AS cwe_id, "
    f"CASE WHEN id % 2 = 0 THEN 'XSS' END AS description, {_CNA} AS source {_C} "
    f"UNION ALL SELECT cve_id, 'CWE-20', 'in', 'cisa-adp' {_C} AND id % 2 = 0")
add("cve_cpe",
    lambda c: DOC.cve_cpe(_boxes(c)).select("cve_id", "cpe23", "vulnerable", "source"),
    f"SELECT cve_id, 'cpe:2.3:a:v:p' || id AS cpe23, id % 4 <> 1 AS vulnerable, {_CNA} AS source {_C}")
add("cve_reference",
    lambda c: DOC.cve_reference(_boxes(c)).select(
        "cve_id", "url", F.array_join("tags", ",").alias("tags"), "source"),
    "SELECT cve_id, 'https://a.example/' || id AS url, CASE WHEN id % 5 = 0 THEN 'Exploit' END AS tags, "
    f"{_CNA} AS source {_C} UNION ALL SELECT cve_id, 'https://shared.example/x', 'patch', {_CNA} {_C}")


add("cve_primary",
    lambda c: DOC.cve_primary(_boxes(c)).withColumn("description_en", F.translate("description_en", "\u0000", "")),
    "SELECT cve_id, 'desc  ' || id AS description_en, CASE WHEN id % 3 = 0 THEN '4.0' ELSE '3.1' END AS primary_cvss_version, "
    "CASE WHEN id % 3 = 0 THEN (id % 90) / 10.0 ELSE (id % 100) / 10.0 END AS primary_cvss_score, "
    "CASE WHEN id % 3 = 0 THEN 'LOW' ELSE 'HIGH' END AS primary_cvss_severity, "
    "CASE WHEN id % 3 = 0 THEN 'CVSS:4.0/AV:N' ELSE 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' END AS primary_cvss_vector, "
    "CASE WHEN id % 2 = 0 THEN 'CWE-79' END AS primary_cwe, id % 5 = 0 AS has_exploit_ref, TRUE AS has_patch_ref, "
    "CASE WHEN id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN 'active' ELSE 'none' END END AS ssvc_exploitation, "
    f"NULL::VARCHAR AS ssvc_automatable, CASE WHEN id % 2 = 0 THEN 'total' END AS ssvc_technical_impact {_C}")
add("primary_cvss",
    lambda c: _boxes(c).select("cve_id", DOC.primary_cvss(F.col("cvss"))["version"].alias("primary_cvss_version")),
    f"SELECT cve_id, CASE WHEN id % 3 = 0 THEN '4.0' ELSE '3.1' END AS primary_cvss_version {_C}")


def _incremental(c: Ctx):
    rec = _records(c).where("cve_id IS NOT NULL").withColumnsRenamed({"cve_id": "k", "raw": "raw_json"})
    base = c.landed.where("cve_id IS NOT NULL").join(rec, F.col("cve_id") == F.col("k"))
    return DOC.enrich_due(base.select(
        F.col("id").alias("n"), F.col("cve_id").alias("id"), F.lit("PUBLISHED").alias("state"),
        F.when(F.col("id") % 6 != 0, F.col("raw_json")).alias("raw_json"),
        F.col("last_seen_at").alias("cvelist_updated_at"),
        F.when(F.col("id") % 4 != 0, F.lit("1997-06-01").cast("timestamp")).alias("enriched_at"),
        F.when(F.col("id") % 10 != 7, "text").alias("description_en"),
        F.lit(None).cast("double").alias("primary_cvss_score"),
        F.lit(None).cast("string").alias("primary_cwe")))


add("enrich_incremental", lambda c: _incremental(c).select("id"),
    f"SELECT cve_id AS id {_C} AND id % 6 <> 0 AND (id % 4 = 0 OR last_seen_at > TIMESTAMP '1997-06-01' OR id % 10 = 7)")

# ---- ecosystem advisories ---------------------------------------------------------


def _osv_docs(c: Ctx):
    events = F.array(s(introduced="0", fixed=F.lit(None).cast("string")),
                     s(introduced=F.lit(None).cast("string"), fixed=F.concat(F.lit("1."), F.col("id").cast("string"))))
    aliases = F.filter(F.array(F.col("cve_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("GHSA-x-"), F.col("id").cast("string"))),
                               F.when(F.col("id") % 9 == 0, F.concat(F.lit("MAL-2026-"), F.col("id").cast("string")))), lambda x: x.isNotNull())
    doc = F.to_json(F.struct(
        F.concat(F.lit("OSV-2026-"), F.col("id").cast("string")).alias("id"), aliases.alias("aliases"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("Bug "), F.col("id").cast("string"))).alias("summary"),
        F.when(F.col("id") % 5 == 0, F.lit("Malicious package found")).alias("details"),
        F.when(F.col("id") % 6 == 0, "0001-01-01T00:00:00Z").otherwise(iso()).alias("published"),
        iso("last_seen_at").alias("modified"),
        F.when(F.col("id") % 8 == 0, iso("last_seen_at")).alias("withdrawn"),
        F.array(s(type="CVSS_V3", score="CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), s(type="x", score="7.5")).alias("severity"),
        F.array(F.struct(
            s(ecosystem=F.when(F.col("id") % 2 == 0, "PyPI").otherwise("Debian:11"), name=F.concat(F.lit("pkg"), F.col("id").cast("string"))).alias("package"),
            F.array(s(type="ECOSYSTEM", events=events)).alias("ranges"),
            s(informational=F.when(F.col("id") % 20 == 13, "unmaintained")).alias("database_specific"))).alias("affected"),
        s(cwe_ids=F.array(F.lit("CWE-79"))).alias("database_specific"),
        F.array(s(url=F.concat(F.lit("https://r.example/"), F.col("id").cast("string")))).alias("references")))
    return c.landed.select(
        F.when(F.col("id") % 2 == 0, "PyPI").otherwise("Debian").alias("ecosystem"), doc.alias("raw"))


_OSV_LABEL = "CASE WHEN id % 2 = 0 THEN 'PyPI' ELSE 'Debian:11' END || ':pkg' || id || ' <1.' || id"
_OSV_OTHERS = ("nullif(concat_ws(' ', CASE WHEN id % 4 = 0 THEN 'GHSA-x-' || id END, "
               "CASE WHEN id % 9 = 0 THEN 'MAL-2026-' || id END), '')")
_OSV_SUMMARY = "CASE WHEN id % 5 = 0 THEN 'Malicious package found' ELSE 'Bug ' || id END"
_OSV_SQL = f"""SELECT 'OSV-2026-' || id AS native_id, cve_id, {_OSV_SUMMARY} AS title,
  {_OSV_SUMMARY} || ' | affected: ' || {_OSV_LABEL} || CASE WHEN {_OSV_OTHERS} IS NULL THEN '' ELSE ' | aliases: ' || {_OSV_OTHERS} END AS snippet,
  {_OSV_OTHERS} AS extra, CASE WHEN id % 6 = 0 THEN last_seen_at ELSE first_seen_at END AS seen_at,
  'pkg' || id || '/-/' || CASE WHEN id % 2 = 0 THEN 'PyPI' ELSE 'Debian:11' END || '/' ||
    CASE WHEN id % 5 = 0 OR id % 9 = 0 THEN 'malware' WHEN id % 2 = 0 THEN 'product' ELSE 'distro' END || '/1' AS affected,
  'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' AS vectors, CASE WHEN id % 8 = 0 THEN TRUE END AS withdrawn
FROM candidates WHERE id % 20 <> 13"""


def _osv_flat(m):
    return m.select("native_id", "cve_id", "title", "snippet", joined("extra_ids").alias("extra"), "seen_at",
                    products(), joined("cvss_vectors").alias("vectors"), "withdrawn")


add("scan_osv", lambda c: _osv_flat(OSV.scan_osv(_osv_docs(c))), _OSV_SQL)
CAP = 300
add("osv_cap_topn",
    lambda c: OSV.osv_cap_topn(OSV.parse_osv(_osv_docs(c)), CAP).select("ecosystem", "id", "modified_at"),
    "SELECT ecosystem, 'OSV-2026-' || id AS id, last_seen_at AS modified_at FROM (SELECT *, "
    "CASE WHEN id % 2 = 0 THEN 'PyPI' ELSE 'Debian' END AS ecosystem, row_number() OVER (PARTITION BY id % 2 "
    f"ORDER BY last_seen_at DESC, 'OSV-2026-' || id DESC) AS rn FROM candidates WHERE id % 20 <> 13) WHERE rn <= {CAP}")


def _cursor_ids(c: Ctx):
    """Both filters over records that are parsed once."""
    records = cut_lineage(OSV.parse_osv(_osv_docs(c), ["id"]).select("id", "modified_at", "seen"))
    return OSV.osv_cursor_filter(records, MID).select("id").unionByName(
        OSV.osv_cursor_filter(records, None, MID).select(F.concat(F.lit("boot-"), "id").alias("id")))


add("osv_cursor_filter", _cursor_ids,
    "SELECT 'OSV-2026-' || id AS id FROM candidates WHERE last_seen_at >= TIMESTAMP '1998-06-30 23:55:00' "
    "UNION ALL SELECT 'boot-OSV-2026-' || id FROM candidates WHERE "
    "CASE WHEN id % 6 = 0 THEN last_seen_at ELSE first_seen_at END >= TIMESTAMP '1998-07-01'")

# ---- hosted advisories, releases, commit logs -------------------------------------


def _ghsa_item(c: Ctx):
    return s(ghsa_id=F.concat(F.lit("GHSA-"), F.col("id").cast("string")), cve_id=F.col("cve_id"),
             summary=F.when(F.col("id") % 7 != 0, F.concat(F.lit(" Sum "), F.col("id").cast("string"))),
             html_url=F.concat(F.lit("https://gh.example/"), F.col("id").cast("string")),
             published_at=F.when(F.col("id") % 3 != 0, iso()), updated_at=iso("last_seen_at"),
             vulnerabilities=F.array(s(package=s(ecosystem=F.when(F.col("id") % 2 == 0, "npm"), name=F.when(F.col("id") % 4 != 3, F.concat(F.lit("p"), F.col("id").cast("string")))),
                                       vulnerable_version_range=F.when(F.col("id") % 5 == 0, "< 2"))),
             cwes=F.array(s(cwe_id="CWE-1")))


_SEEN = "CASE WHEN id % 3 <> 0 THEN first_seen_at ELSE last_seen_at END"
add("scan_ghsa",
    lambda c: GH.scan_ghsa(pages(c.landed, _ghsa_item(c))).select(
        "url", "title", "snippet", "cve_id", "native_id", "seen_at"),
    f"SELECT 'https://gh.example/' || id AS url, CASE WHEN id % 7 <> 0 THEN ' Sum ' || id ELSE coalesce(cve_id, 'GHSA-' || id) END AS title, "
    "nullif(CASE WHEN id % 7 <> 0 THEN ' Sum ' || id ELSE '' END || CASE WHEN id % 4 <> 3 THEN ' | affected: ' || "
    "CASE WHEN id % 2 = 0 THEN 'npm' ELSE 'None' END || ':p' || id || CASE WHEN id % 5 = 0 THEN ' < 2' ELSE '' END ELSE '' END, '') AS snippet, "
    f"cve_id, 'GHSA-' || id AS native_id, {_SEEN} AS seen_at FROM candidates")
_REPO_SQL = "'own' || (id % 40) || '/rep' || (id % 90)"


def _with_repo(c: Ctx):
    return c.landed.withColumn("full_name", F.concat(
        F.lit("own"), (F.col("id") % 40).cast("string"), F.lit("/rep"), (F.col("id") % 90).cast("string")))


add("scan_repo_advisories",
    lambda c: GH.scan_repo_advisories(pages(_with_repo(c), _ghsa_item(c), size=500, keep=["full_name"])).select(
        "full_name", "title", "snippet", "cve_id", "native_id", joined("extra_ids").alias("extra"), "seen_at",
        products(), joined("cwe_ids").alias("cwes")),
    f"SELECT {_REPO_SQL} AS full_name, CASE WHEN id % 7 <> 0 THEN 'Sum ' || id ELSE coalesce(cve_id, 'GHSA-' || id) END AS title, "
    f"'[repo advisory ' || {_REPO_SQL} || '] ' || CASE WHEN id % 7 <> 0 THEN 'Sum ' || id ELSE '' END AS snippet, cve_id, "
    "CASE WHEN cve_id IS NULL THEN 'GHSA-' || id END AS native_id, CASE WHEN cve_id IS NOT NULL THEN 'GHSA-' || id END AS extra, "
    f"{_SEEN} AS seen_at, CASE WHEN id % 4 <> 3 THEN 'p' || id || '/-/' || CASE WHEN id % 2 = 0 THEN 'npm' ELSE '-' END || '/product/0' "
    "ELSE 'rep' || (id % 90) || '/own' || (id % 40) || '/-/product/0' END AS affected, 'CWE-1' AS cwes FROM candidates")


def _releases(c: Ctx):
    item = s(name=F.concat(F.lit("v"), F.col("id").cast("string")), body=F.concat(F.lit("fixes "), F.lower(cve_col()), F.lit(" and CVE-2001-0001; again "), cve_col()),
             tag_name=F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))), html_url=F.concat(F.lit("https://rel.example/"), F.col("id").cast("string")),
             published_at=F.when(F.col("id") % 3 != 0, iso()), created_at=iso("last_seen_at"))
    return pages(_with_repo(c), item, size=500, keep=["full_name"])


_REL = (f"(SELECT *, {_REPO_SQL} AS full_name, CASE WHEN id % 2 = 0 THEN 't' ELSE 'v' END || id AS tag, unnest([{CVE}, 'CVE-2001-0001']) AS one FROM candidates)")
add("scan_releases",
    lambda c: GH.scan_releases(_releases(c)).select("full_name", "title", "snippet", "cve_id", "seen_at", "url"),
    f"SELECT full_name, full_name || ' ' || tag || ': ' || one AS title, '[release ' || full_name || ' ' || tag || '] cita ' || one AS snippet, "
    f"one AS cve_id, {_SEEN} AS seen_at, 'https://rel.example/' || id AS url FROM {_REL}")
add("repo_emit_filter",
    lambda c: GH.repo_emit_filter(c.landed.select(
        "id", F.when(F.col("id") % 10 != 0, F.col("first_seen_at")).alias("seen_at"),
        F.when(F.col("id") % 3 != 0, F.lit("1999-01-01").cast("timestamp")).alias("watermark")), MID).select("id"),
    "SELECT id FROM candidates WHERE CASE WHEN id % 10 = 0 THEN id % 3 = 0 WHEN id % 3 <> 0 THEN first_seen_at > TIMESTAMP '1999-01-01' "
    "ELSE first_seen_at >= TIMESTAMP '1998-07-01' END")


def _records_of(c: Ctx):
    """Commit records; the offset makes text order differ from time order."""
    msg = (F.when(F.col("id") % 4 == 0, F.concat(F.lit("fix "), cve_col(), F.lit("\nalso cve-2001-00012, "), cve_col()))
           .when(F.col("id") % 4 == 1, "Fix heap buffer overflow\n\ndetails").otherwise("update readme"))
    stamp = F.concat(F.date_format(F.col("first_seen_at") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return _with_repo(c).select("id", "full_name", F.concat(
        F.lit("\n"), F.sha1(F.col("id").cast("string")), F.lit(GH.FIELD), stamp, F.lit(GH.FIELD), msg, F.lit("\n")).alias("record"))


_LOGROWS = (f"(SELECT *, {_REPO_SQL} AS full_name, unnest(CASE WHEN id % 4 = 0 THEN [{CVE}, 'CVE-2001-00012'] WHEN id % 4 = 1 THEN [NULL] ELSE [] END) AS one, "
            "CASE WHEN id % 4 = 0 THEN 'fix ' || " + CVE + " ELSE 'Fix heap buffer overflow' END AS first_line FROM candidates)")
add("scan_gitlog",
    lambda c: GH.scan_gitlog(_records_of(c), synthesize=True).select(
        "full_name", "sha", "title", "cve_id", "native_id", "seen_at", F.md5("snippet").alias("snippet")),
    "SELECT full_name, sha1(CAST(id AS STRING)) AS sha, full_name || ': ' || first_line AS title, one AS cve_id, "
    "CASE WHEN one IS NULL THEN 'GHCOMMIT:' || full_name || '@' || substring(sha1(CAST(id AS STRING)), 1, 12) END AS native_id, "
    "first_seen_at AS seen_at, md5('[' || full_name || '] ' || CASE WHEN id % 4 = 0 THEN 'fix ' || " + CVE +
    " || chr(10) || 'also cve-2001-00012, ' || " + CVE + " ELSE 'Fix heap buffer overflow' || chr(10) || chr(10) || 'details' END) AS snippet "
    f"FROM {_LOGROWS}")
add("gitlog_watermarks", lambda c: GH.gitlog_watermarks(_records_of(c)),
    f"SELECT {_REPO_SQL} AS full_name, max(first_seen_at) AS watermark FROM candidates GROUP BY 1")
add("gitlog_merge_cache",
    lambda c: GH.gitlog_merge_cache(_records_of(c).where("id % 3 = 0"), _records_of(c)).select("full_name", "sha"),
    f"SELECT {_REPO_SQL} AS full_name, sha1(CAST(id AS STRING)) AS sha FROM candidates WHERE id % 3 = 0 OR id % 4 IN (0, 1)")
add("scan_single_repo",
    lambda c: GH.scan_single_repo(_records_of(c), "own4/rep4", dt.datetime(2000, 1, 1, tzinfo=UTC), 60,
                                  dt.datetime(1997, 3, 4, 5, tzinfo=UTC)).select("sha", "cve_id", "seen_at"),
    "SELECT sha1(CAST(id AS STRING)) AS sha, one AS cve_id, first_seen_at AS seen_at "
    f"FROM {_LOGROWS} WHERE full_name = 'own4/rep4' AND one IS NOT NULL AND first_seen_at >= TIMESTAMP '1997-03-04'")

# ---- exploited and exploit lists --------------------------------------------------
add("scan_cisa_kev",
    lambda c: EX.scan_cisa_kev(pages(c.landed, s(
        cveID=F.col("cve_id"), dateAdded=F.when(F.col("id") % 4 != 1, iso(pattern="yyyy-MM-dd")).otherwise("soon"),
        vendorProject=F.concat(F.lit("V"), (F.col("id") % 9).cast("string")), product=F.lit(""),
        vulnerabilityName=F.when(F.col("id") % 3 != 0, F.concat(F.lit("Name "), F.col("id").cast("string"))), shortDescription="short",
        knownRansomwareCampaignUse=F.when(F.col("id") % 2 == 0, "Known")), "vulnerabilities")).select(
        "url", "title", "snippet", "cve_id", "seen_at", "flags.in_kev", "flags.kev_date", "flags.kev_source"),
    "SELECT 'https://nvd.nist.gov/vuln/detail/' || cve_id AS url, 'KEV: ' || CASE WHEN id % 3 <> 0 THEN 'Name ' || id ELSE cve_id END AS title, "
    "concat_ws(' | ', 'V' || (id % 9), CASE WHEN id % 3 <> 0 THEN 'Name ' || id END, CASE WHEN id % 2 = 0 THEN 'ransomware=Known' END, 'short') AS snippet, "
    "cve_id, CASE WHEN id % 4 <> 1 THEN first_seen_at END AS seen_at, TRUE AS in_kev, "
    f"CASE WHEN id % 4 <> 1 THEN CAST(first_seen_at AS DATE) END AS kev_date, 'cisa' AS kev_source {_C}")
add("scan_vulncheck_kev",
    lambda c: EX.scan_vulncheck_kev(pages(c.landed, F.struct(
        F.array(cve_col(), F.concat(F.lit("CVE-2001-"), F.lpad(F.col("id").cast("string"), 8, "0"))).alias("cve"),
        iso("last_seen_at").alias("date_added"), F.lit("Acme").alias("vendorProject"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("prod"), F.col("id").cast("string"))).alias("product"), F.lit("d").alias("description"),
        F.lit("Unknown").alias("knownRansomwareCampaignUse"), F.array(F.lit("CWE-9")).alias("cwes"),
        F.when(F.col("id") % 3 == 0, F.array(s(xdb_url=F.concat(F.lit("https://x.example/"), F.col("id").cast("string")), clone_ssh_url="git@github.com:o/r.git"))).alias("vulncheck_xdb"),
        F.array(s(url="https://rep.example", date_added=F.when(F.col("id") % 5 != 0, iso()).otherwise("0001-01-01T00:00:00Z")))
        .alias("vulncheck_reported_exploitation")), "data")).select(
        "cve_id", "title", "snippet", "seen_at", "flags.kev_date", "flags.kev_source", "flags.has_public_poc", products(),
        joined("reference_urls").alias("refs")),
    f"SELECT unnest([{CVE}, 'CVE-2001-' || lpad(CAST(id AS STRING), 8, '0')]) AS cve_id, "
    f"'VulnCheck KEV: ' || CASE WHEN id % 2 = 0 THEN 'prod' || id ELSE {CVE} END AS title, "
    "concat_ws(' | ', 'Acme', CASE WHEN id % 2 = 0 THEN 'prod' || id END, 'd') AS snippet, "
    "CASE WHEN id % 5 <> 0 THEN first_seen_at ELSE last_seen_at END AS seen_at, "
    "CAST(CASE WHEN id % 5 <> 0 THEN first_seen_at ELSE last_seen_at END AS DATE) AS kev_date, 'vulncheck' AS kev_source, "
    "CASE WHEN id % 3 = 0 THEN TRUE END AS has_public_poc, CASE WHEN id % 2 = 0 THEN 'prod' || id || '/Acme/-/-/0' END AS affected, "
    "CASE WHEN id % 3 = 0 THEN 'https://x.example/' || id || ' https://github.com/o/r ' ELSE '' END || 'https://rep.example' AS refs FROM candidates")
add("scan_exploitdb",
    lambda c: EX.scan_exploitdb(c.landed.select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit(" Exploit "), F.col("id").cast("string")).alias("description"),
        F.when(F.col("id") % 3 != 0, iso(pattern="yyyy-MM-dd")).when(F.col("id") % 6 == 0, "n/a").alias("date_added"),
        F.when(F.col("id") % 6 != 0, iso(pattern="yyyy-MM-dd HH:mm")).alias("date_published"), F.lit("webapps").alias("type"),
        F.concat(F.lower(cve_col()), F.when(F.col("id") % 2 == 0, ";OSVDB-1;CVE-2001-0001").otherwise("")).alias("codes"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://src.example/"), F.col("id").cast("string"))).alias("source_url")), MID).select(
        "url", "title", "snippet", "cve_id", "seen_at", "flags.has_public_poc"),
    f", e AS (SELECT *, {CVE} AS own, lower({CVE}) || CASE WHEN id % 2 = 0 THEN ';OSVDB-1;CVE-2001-0001' ELSE '' END AS codes, "
    "CASE WHEN id % 6 = 0 THEN NULL ELSE first_seen_at END AS seen FROM candidates) "
    "SELECT CASE WHEN id % 4 = 0 THEN 'https://src.example/' || id ELSE 'https://www.exploit-db.com/exploits/' || id END AS url, "
    "'Exploit ' || id AS title, 'Exploit-DB #' || id || ' [webapps] Exploit ' || id || ' | codes: ' || codes AS snippet, "
    "unnest(CASE WHEN id % 2 = 0 THEN [own, 'CVE-2001-0001'] ELSE [own] END) AS cve_id, seen AS seen_at, TRUE AS has_public_poc "
    "FROM e WHERE seen IS NULL OR seen >= TIMESTAMP '1998-07-01' - INTERVAL 120 DAY")
add("scan_poc_index_json",
    lambda c: EX.scan_poc_index_json(c.landed.select(
        F.concat(F.lower(cve_col()), F.lit(".json")).alias("file_name"), F.to_json(F.transform(
            F.sequence(F.lit(0), (F.col("id") % 70).cast("int")), lambda i: s(
                html_url=F.concat(F.lit("https://gh.example/"), F.col("id").cast("string"), F.lit("/"), i.cast("string")),
                description=F.when(i == 1, "second"),
                created_at=F.date_format(F.col("first_seen_at") + F.make_dt_interval(F.lit(3) - i), "yyyy-MM-dd'T'HH:mm:ss'Z'")))).alias("raw"))).select(
        "cve_id", "title", "snippet", "seen_at", "flags.has_public_poc", F.size("reference_urls").alias("n_refs"), "url"),
    f"SELECT {CVE} AS cve_id, 'PoC público: ' || {CVE} || ' (' || (id % 70 + 1) || ' repos)' AS title, CASE WHEN id % 70 >= 1 THEN 'second' END AS snippet, "
    "first_seen_at + INTERVAL 1 DAY * CAST(3 - id % 70 AS INT) AS seen_at, TRUE AS has_public_poc, CAST(least(id % 70 + 1, 50) AS INTEGER) AS n_refs, "
    "'https://gh.example/' || id || '/0' AS url FROM candidates")
add("scan_poc_index_md",
    lambda c: EX.scan_poc_index_md(c.landed.select(
        F.concat(cve_col(), F.lit(".md")).alias("file_name"), F.concat(
            F.lit("### title\n"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("![](https://img.example/v1?label=Product&message=Big%20App%2B"), F.col("id").cast("string"), F.lit("&color=blue)\n"))).otherwise(""),
            F.lit("- https://github.com/foo/"), F.col("id").cast("string"), F.lit("\n- https://github.com/bar/poc\n- https://github.com/foo/"), F.col("id").cast("string")).alias("raw"))).select(
        "cve_id", "title", "snippet", joined("reference_urls").alias("refs")),
    f"SELECT {CVE} AS cve_id, {CVE} || CASE WHEN id % 2 = 0 THEN ': Big App+' || id ELSE '' END AS title, "
    "CASE WHEN id % 2 = 0 THEN 'trickest PoC index | product=Big App+' || id END AS snippet, "
    "'https://github.com/foo/' || id || ' https://github.com/bar/poc' AS refs FROM candidates")

# ---- vendors ----------------------------------------------------------------------
add("scan_redhat",
    lambda c: VD.scan_redhat(pages(c.landed, s(
        CVE=F.col("cve_id"), bugzilla_description=F.when(F.col("id") % 3 != 0, F.concat(F.lit("desc "), F.col("id").cast("string"))),
        severity=F.when(F.col("id") % 2 == 0, "important"), cvss3_scoring_vector=F.when(F.col("id") % 4 == 0, "CVSS:3.1/AV:N"),
        cvss_scoring_vector=F.when(F.col("id") % 6 == 0, "AV:N/AC:L"), public_date=iso(), resource_url=F.concat(F.lit("https://rh.example/"), F.col("id").cast("string"))))).select(
        "url", "title", "snippet", "cve_id", "seen_at"),
    "SELECT 'https://rh.example/' || id AS url, CASE WHEN id % 3 <> 0 THEN 'desc ' || id ELSE cve_id END AS title, "
    "nullif(CASE WHEN id % 2 = 0 THEN '[important] ' ELSE '' END || CASE WHEN id % 3 <> 0 THEN 'desc ' || id ELSE '' END || "
    "CASE WHEN id % 4 = 0 THEN ' | CVSS: CVSS:3.1/AV:N' WHEN id % 6 = 0 THEN ' | CVSS: AV:N/AC:L' ELSE '' END, '') AS snippet, "
    f"cve_id, first_seen_at AS seen_at {_C}")
add("scan_cisco",
    lambda c: VD.scan_cisco(pages(c.landed, s(
        identifier=F.concat(F.lit("sa-"), F.col("id").cast("string")), title=F.concat(F.lit(" Adv "), F.col("id").cast("string")), cve=cve_col(),
        summary=F.when(F.col("id") % 2 == 0, "y CVE-2001-0002 tambien"), severity=F.when(F.col("id") % 3 == 0, "High"),
        firstPublished=iso(pattern="yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"), url=F.concat(F.lit("https://ci.example/"), F.col("id").cast("string"))))).select(
        "url", "title", "snippet", "cve_id", "seen_at"),
    "SELECT 'https://ci.example/' || id AS url, 'Adv ' || id AS title, CASE WHEN id % 3 = 0 THEN '[High] ' ELSE '' END || 'Adv ' || id || ' | ' || "
    "CASE WHEN id % 2 = 0 THEN 'y CVE-2001-0002 tambien' ELSE '' END AS snippet, "
    f"unnest(CASE WHEN id % 2 = 0 THEN [{CVE}, 'CVE-2001-0002'] ELSE [{CVE}] END) AS cve_id, first_seen_at AS seen_at FROM candidates")


def _wordfence(c: Ctx):
    body = F.struct(
        F.concat(F.lit(" Plugin "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 2, F.concat(F.lit(" ("), cve_col(), F.lit(")"))).otherwise("")).alias("title"),
        F.when(F.col("id") % 3 == 0, cve_col()).when(F.col("id") % 3 == 1, F.concat(F.lit('["'), cve_col(), F.lit('","CVE-2001-0003"]'))).alias("cve"),
        iso().alias("published"), F.array(s(name=F.when(F.col("id") % 2 == 0, F.concat(F.lit("wp"), F.col("id").cast("string"))), slug=F.concat(F.lit("slug"), F.col("id").cast("string")))).alias("software"),
        F.array(s(url=F.concat(F.lit("https://wf.example/"), F.col("id").cast("string")))).alias("references"))
    text = F.to_json(body)
    # The list form of the field is a real array in the payload.
    text = F.regexp_replace(text, r'"cve":"\[\\"([^\\]*)\\",\\"([^\\]*)\\"\]"', r'"cve":["$1","$2"]')
    return c.landed.select(F.concat(F.lit('{"k'), F.col("id").cast("string"), F.lit('":'), text, F.lit("}")).alias("raw"))


add("scan_wordfence",
    lambda c: VD.scan_wordfence(_wordfence(c), MID).select(
        "url", "title", "snippet", "cve_id", "seen_at", products()),
    f", w AS (SELECT *, {CVE} AS own, 'Plugin ' || id || CASE WHEN id % 3 = 2 THEN ' (' || {CVE} || ')' ELSE '' END AS t FROM candidates "
    "WHERE first_seen_at >= TIMESTAMP '1998-07-01' - INTERVAL 120 DAY) "
    "SELECT 'https://wf.example/' || id AS url, t AS title, t AS snippet, unnest(CASE WHEN id % 3 = 1 THEN [own, 'CVE-2001-0003'] ELSE [own] END) AS cve_id, "
    "first_seen_at AS seen_at, CASE WHEN id % 2 = 0 THEN 'wp' ELSE 'slug' END || id || '/-/wordpress/product/0' AS affected FROM w")
add("scan_gemnasium",
    lambda c: VD.scan_gemnasium(c.landed.select(F.lit("pypi").alias("ecosystem"), F.to_json(s(
        identifiers=F.filter(F.array(F.concat(F.lit("GHSA-"), F.col("id").cast("string")), F.col("cve_id")), lambda x: x.isNotNull()),
        package_slug=F.concat(F.lit("pypi/Grp/Pkg"), F.col("id").cast("string")), title=F.concat(F.lit("T "), F.col("id").cast("string")), description=" d ",
        pubdate=iso(pattern="yyyy-MM-dd"), affected_range=">=1,<2||>=3,<4", fixed_versions=F.array(F.lit("2"), F.lit("4")),
        urls=F.array(F.concat(F.lit("https://gl.example/"), F.col("id").cast("string"))), cwe_ids=F.array(F.lit("CWE-7")))).alias("raw")), MID).select(
        "url", "title", "snippet", "cve_id", "native_id", joined("extra_ids").alias("extra"), "seen_at", products(),
        joined(F.col("affected")[0]["exact_versions"]).alias("exact")),
    "SELECT 'https://gl.example/' || id AS url, 'T ' || id AS title, 'T ' || id || ' | d' AS snippet, cve_id, "
    "CASE WHEN cve_id IS NULL THEN 'GHSA-' || id END AS native_id, CASE WHEN cve_id IS NOT NULL THEN 'GHSA-' || id END AS extra, "
    "first_seen_at AS seen_at, 'Grp/Pkg' || id || '/-/pypi/-/2' AS affected, '2 4' AS exact FROM candidates "
    "WHERE first_seen_at >= TIMESTAMP '1998-07-01' - INTERVAL 180 DAY")

# ---- feeds, pages, listings -------------------------------------------------------


def _entries(c: Ctx):
    return c.planted.select(
        "doc_id", F.concat(F.lit("Entry "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("summary"),
        F.concat(F.lit("https://feed.example/"), F.col("doc_id").cast("string")).alias("link"),
        F.timestamp_seconds(F.lit(900000000) + F.col("doc_id") * 3600).alias("seen_at"))


_CVES_OF = "list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)CVE-[0-9]{4}-[0-9]{4,}'), lambda x: upper(x))))"
_SEEN_DOC = "make_timestamp((900000000 + doc_id * 3600) * 1000000)"
add("scan_feed_entries",
    lambda c: FD.scan_feed_entries(_entries(c)).select(
        "doc_id", "url", "title", "cve_id", "seen_at", F.size(F.coalesce("extra_ids", F.array().cast("array<string>"))).alias("n_extra"),
        "native_id", F.md5("snippet").alias("snippet")),
    f", d AS (SELECT *, {_CVES_OF} AS cves, list_filter([CASE WHEN doc_id % 11 = 0 THEN 'ZDI-CAN-' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END, "
    "CASE WHEN doc_id % 13 = 0 THEN 'VU#904217' END, CASE WHEN doc_id % 7 = 0 THEN 'GHSA-2345-6789-cfgh' END, CASE WHEN doc_id % 13 = 0 THEN 'ADV310077' END, "
    "CASE WHEN doc_id % 17 = 0 THEN 'PYSEC-2026-' || doc_id END], lambda x: x IS NOT NULL) AS others FROM planted) "
    "SELECT doc_id, 'https://feed.example/' || doc_id AS url, 'Entry ' || doc_id AS title, "
    "unnest(CASE WHEN len(cves) > 0 THEN cves WHEN len(others) > 0 THEN [NULL] ELSE [] END) AS cve_id, "
    "CASE WHEN len(cves) = 0 THEN others[1] END AS native_id, "
    f"{_SEEN_DOC} AS seen_at, CASE WHEN len(cves) = 1 THEN len(others) WHEN len(cves) = 0 THEN len(others) - 1 ELSE 0 END AS n_extra, "
    "md5(substring('Entry ' || doc_id || ' | ' || text, 1, 2000)) AS snippet FROM d")
add("scan_kernel_cve",
    lambda c: FD.scan_kernel_cve(c.planted.select(
        F.concat(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("cve-2026-"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))).otherwise("Note"),
                 F.lit(": xfs: fix "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("<p>a</p>\n <b>b"), F.col("doc_id").cast("string"), F.lit("</b>"), "text").alias("summary"),
        F.lit("https://lore.example/1").alias("link"), F.lit(None).cast("timestamp").alias("seen_at"))).select(
        "title", F.md5("snippet").alias("snippet"), "cve_id", products()),
    "SELECT 'xfs: fix ' || doc_id AS title, md5(substring(trim(regexp_replace('xfs: fix ' || doc_id || ' | a b' || doc_id || ' ' || "
    "regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 2000)) AS snippet, "
    "'CVE-2026-' || lpad(CAST(doc_id AS STRING), 7, '0') AS cve_id, 'Linux Kernel/Linux/-/product/0' AS affected FROM planted WHERE doc_id % 5 <> 0")
JEN = dt.datetime.fromtimestamp(900000000 + 86400 * 130, tz=UTC)
add("scan_jenkins",
    lambda c: FD.scan_jenkins(_entries(c).drop("summary"), c.planted.select(
        F.concat(F.lit("https://feed.example/"), F.col("doc_id").cast("string")).alias("link"), "text"), JEN).select(
        "url", "title", "snippet", "cve_id", "seen_at"),
    f", d AS (SELECT *, {_CVES_OF} AS cves FROM planted WHERE doc_id * 3600 >= 86400 * 10) "
    "SELECT url, 'Entry ' || doc_id || ': ' || cve_id AS title, 'Entry ' || doc_id AS snippet, cve_id, seen_at FROM "
    f"(SELECT doc_id, 'https://feed.example/' || doc_id AS url, unnest(cves) AS cve_id, {_SEEN_DOC} AS seen_at FROM d)")
add("scan_plugin_listing",
    lambda c: FD.scan_plugin_listing(c.driver("pages").select("page_id", F.concat(
        "html", F.lit('<table><tr class="h"><th>CVE-0000-0000</th></tr><tr><td><a class="x" href="/plugins/nessus/'),
        F.col("page_id").cast("string"), F.lit('">Fix &amp; <b>Foo</b></a></td>\n<td> CVE-2026-'), F.lpad(F.col("page_id").cast("string"), 5, "0"),
        F.lit(' '), F.repeat(F.lit("x"), 2500), F.lit(' cve-2027-'), F.lpad(F.col("page_id").cast("string"), 6, "0"),
        F.lit(' </td></tr><tr><td><a href="/plugins/nessus/9">nothing</a></td></tr></table>')).alias("raw"))).select(
        "page_id", "url", "title", F.md5("snippet").alias("snippet"), F.array_join(F.transform("whole_text_ids", lambda i: i["value"]), ",").alias("ids")),
    "SELECT page_id, 'https://www.tenable.com/plugins/nessus/' || page_id AS url, 'Fix &Foo' AS title, "
    "md5(substring('Fix & Foo CVE-2026-' || lpad(CAST(page_id AS STRING), 5, '0') || ' ' || repeat('x', 2500), 1, 2000)) AS snippet, "
    "'CVE-2026-' || lpad(CAST(page_id AS STRING), 5, '0') || ',CVE-2027-' || lpad(CAST(page_id AS STRING), 6, '0') AS ids FROM pages")
add("scan_news",
    lambda c: FD.scan_news(_entries(c)).select("doc_id", "url", "title", F.md5("snippet").alias("snippet"), "cve_id", "seen_at",
                                           F.size(F.filter("whole_text_ids", lambda i: i["scheme"] == "CVE")).alias("n_cves")),
    f"SELECT doc_id, 'https://feed.example/' || doc_id AS url, 'Entry ' || doc_id AS title, md5(substring(text, 1, 2000)) AS snippet, len({_CVES_OF}) AS n_cves, "
    "upper(regexp_extract(text, '(?i)CVE-[0-9]{4}-[0-9]{4,}')) AS cve_id, "
    f"{_SEEN_DOC} AS seen_at FROM planted WHERE contains(upper(text), 'CVE-')")

# ---- sinks ------------------------------------------------------------------------


def _sink(c: Ctx):
    """A report written as CSV and read back."""
    top = R.pending_top(c.facts, c.affected_products, "all", 200)
    path = sinks.sink_rows(top, scratch_path(c.spark, "report"))
    return c.spark.read.schema("software STRING, pending BIGINT").option("header", "true").csv(path)


def _document(c: Ctx):
    """All products with their counts as a JSON document, data and meta read back."""
    rows = R.pending_breakdown(c.facts, c.affected_products)
    path = sinks.sink_document(rows, scratch_path(c.spark, "document"), rows.agg(F.sum("n").alias("n")))
    data = c.spark.read.schema(rows.schema).json(f"{path}/data")
    return data.unionByName(c.spark.read.schema("n BIGINT").json(f"{path}/meta").select(
        F.lit("meta").alias("dim"), F.lit("sum").alias("key"), "n"))


add("sink_document", _document,
    ", pend AS (SELECT * FROM facts WHERE pending), counted AS (SELECT 'eco' AS dim, coalesce(ecosystem, '(sin ecosistema)') AS key, "
    "count(DISTINCT p.id) AS n FROM pend p JOIN affected_products a ON a.candidate_id = p.id AND a.kind IS DISTINCT FROM 'malware' GROUP BY 2 "
    "UNION ALL SELECT 'maturity', maturity, count(*) FROM pend GROUP BY 2) "
    "SELECT * FROM counted UNION ALL SELECT 'meta', 'sum', CAST(sum(n) AS BIGINT) FROM counted")
add("sink_rows", _sink,
    "SELECT a.product AS software, count(DISTINCT f.id) AS pending FROM facts f JOIN affected_products a ON a.candidate_id = f.id "
    "WHERE f.pending GROUP BY 1 ORDER BY pending DESC, software LIMIT 200")
