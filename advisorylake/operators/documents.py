"""CVE JSON 5 records -> normalised child tables and the primary picks.

The record is parsed once into typed arrays, ordered by container (CNA first, then each
ADP) and list position; each child table explodes one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.functions.text import bind, blank_to_null, first_of
from advisorylake.operators.stages import compute_once
from advisorylake.session import cut_lineage

_BLOCK = ("struct<version:string,vectorString:string,baseScore:double,baseSeverity:string,"
          "exploitabilityScore:double,impactScore:double>")
# Metric key -> version, in lookup order.
CVSS_KEYS = [("cvssV2_0", "2.0"), ("cvssV2", "2.0"), ("cvssV3_0", "3.0"), ("cvssV3_1", "3.1"),
             ("cvssV4_0", "4.0")]
VERSION_RANK = {"4.0": 4, "3.1": 3, "3.0": 2, "2.0": 1}
_METRIC = ("struct<type:string,other:struct<type:string,content:struct<options:"
           "array<map<string,string>>>>," + ",".join(f"{k}:{_BLOCK}" for k, _ in CVSS_KEYS) + ">")
_DESCRIPTION = "struct<cweId:string,description:string>"
_PROBLEM = f"struct<descriptions:array<{_DESCRIPTION}>>"
_AFFECTED = "struct<defaultStatus:string,cpes:array<string>>"
_REFERENCE = "struct<url:string,tags:array<string>>"
_CONTAINER_LISTS = ["metrics", "problemTypes", "affected", "references"]
_CONTAINER = (
    f"struct<providerMetadata:struct<shortName:string,orgId:string>,metrics:array<{_METRIC}>,"
    f"problemTypes:array<{_PROBLEM}>,affected:array<{_AFFECTED}>,references:array<{_REFERENCE}>,"
    "descriptions:array<struct<lang:string,value:string>>>")
RECORD = f"containers struct<cna:{_CONTAINER},adp:array<{_CONTAINER}>>"


def parse_records(records: DataFrame) -> DataFrame:
    """cve_id, raw -> cve_id and typed arrays: boxes, cvss, cwe, cpe, refs.

    Everything about one CVE sits in its own record, so lists are ordered, de-duplicated
    and ranked inside the row. No child table and no primary pick needs a shuffle.
    """
    parsed = compute_once(records.select("cve_id", "raw"),
                          c=F.from_json("raw", RECORD)["containers"])
    # An absent CNA keeps ordinal 0 free, so ADP ordinals always start at 1.
    listed = F.concat(F.array("c.cna"), F.coalesce("c.adp", F.array().cast(f"array<{_CONTAINER}>")))

    def box(container: Column, ordinal: Column) -> Column:
        meta = container["providerMetadata"]
        name = F.coalesce(first_of(meta["shortName"], meta["orgId"]), F.lit("unknown"))
        adp = (ordinal > 0) & (name == "CISA-ADP")
        return F.struct(ordinal.alias("ordinal"), (ordinal == 0).alias("from_cna"),
                        F.when(adp, "cisa-adp").otherwise(name).alias("source"),
                        container.alias("container"))

    boxes = F.filter(F.transform(listed, box), lambda b: b["container"].isNotNull())
    parsed = compute_once(parsed.select("cve_id", "c"), boxes=boxes)
    return compute_once(
        parsed.select("cve_id", "boxes"), cvss=_each(_box_cvss), cwe=_each(_box_cwe),
        cpe=_each(_box_cpe), refs=_first_per_url(_each(_box_refs)))


def _each(read) -> Column:
    """Concatenate ``read(box)`` over the boxes in order."""
    return F.flatten(F.transform("boxes", read))


def _box_cvss(box: Column) -> Column:
    def blocks(metric: Column) -> Column:
        rows = [F.when(metric[key].isNotNull(), F.struct(
            first_of(metric[key]["version"], F.lit(version)).alias("version"),
            box["source"].alias("source"), box["from_cna"].alias("from_cna"),
            metric["type"].alias("type"), metric[key]["vectorString"].alias("vector"),
            metric[key]["baseScore"].alias("base_score"),
            blank_to_null(F.upper(metric[key]["baseSeverity"])).alias("base_severity"),
            metric[key]["exploitabilityScore"].alias("exploitability_score"),
            metric[key]["impactScore"].alias("impact_score"))) for key, version in CVSS_KEYS]
        return F.filter(F.array(*rows), lambda x: x.isNotNull())

    return F.flatten(F.transform(_list(box, "metrics", _METRIC), blocks))


def _box_cwe(box: Column) -> Column:
    def rows(problem: Column) -> Column:
        def row(d: Column) -> Column:
            cwe, text = blank_to_null(d["cweId"]), blank_to_null(d["description"])
            return F.when(F.coalesce(cwe, text).isNotNull(), F.struct(
                F.coalesce(cwe, text).alias("cwe_id"),
                F.when(cwe.isNotNull(), d["description"]).alias("description"),
                box["source"].alias("source")))

        return F.filter(F.transform(_list(problem, "descriptions", _DESCRIPTION), row),
                        lambda x: x.isNotNull())

    return F.flatten(F.transform(_list(box, "problemTypes", _PROBLEM), rows))


def _box_cpe(box: Column) -> Column:
    """A missing default status counts as vulnerable."""
    def rows(affected: Column) -> Column:
        names = F.filter(_list(affected, "cpes", "string"), lambda x: x.startswith("cpe:"))
        vulnerable = F.coalesce(affected["defaultStatus"], F.lit("")) != "unaffected"
        return F.transform(names, lambda x: F.struct(
            x.alias("cpe23"), vulnerable.alias("vulnerable"), box["source"].alias("source")))

    return F.flatten(F.transform(_list(box, "affected", _AFFECTED), rows))


def _box_refs(box: Column) -> Column:
    def row(r: Column) -> Column:
        tags = F.filter(_list(r, "tags", "string"), lambda t: t.isNotNull())
        return F.struct(r["url"].alias("url"), F.when(F.size(tags) > 0, tags).alias("tags"),
                        box["source"].alias("source"))

    return F.transform(F.filter(_list(box, "references", _REFERENCE), lambda r: r["url"] != ""), row)


def _first_per_url(refs: Column) -> Column:
    """First occurrence of each URL; later tags of the same URL are ignored."""
    return bind(F.struct(refs.alias("r"), F.transform(refs, lambda r: r["url"]).alias("u")),
                lambda p: F.filter(p["r"], lambda r, i: F.array_position(p["u"], r["url"]) == i + 1))


def _list(owner: Column, name: str, item: str) -> Column:
    """A list field of a box's container or of a nested record; missing counts as empty."""
    source = owner["container"][name] if name in _CONTAINER_LISTS else owner[name]
    return F.coalesce(source, F.array().cast(f"array<{item}>"))


def cve_containers(parsed: DataFrame) -> DataFrame:
    """One row per container: CNA first, then each ADP."""
    return parsed.select("cve_id", F.inline("boxes")).select(
        "cve_id", "ordinal", "from_cna", "source")


def cve_cvss(parsed: DataFrame) -> DataFrame:
    """One row per (metric, cvss key)."""
    return parsed.select("cve_id", F.inline("cvss")).drop("from_cna")


def cve_cwe(parsed: DataFrame) -> DataFrame:
    return parsed.select("cve_id", F.inline("cwe"))


def cve_cpe(parsed: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    bounds = ["version_start", "version_start_type", "version_end", "version_end_type"]
    return parsed.select("cve_id", F.inline("cpe")).select(
        "cve_id", "cpe23", "vulnerable", *[none.alias(c) for c in bounds], "source")


def cve_reference(parsed: DataFrame) -> DataFrame:
    return parsed.select("cve_id", F.inline("refs"))


def primary_cvss(cvss: Column) -> Column:
    """Highest version, then CNA over ADP, then type Primary, then first in order."""
    def ranked(c: Column, i: Column) -> Column:
        version = F.lit(0)
        for name, value in VERSION_RANK.items():
            version = F.when(c["version"] == name, value).otherwise(version)
        secondary = ~F.coalesce(F.lower(c["type"]) == "primary", F.lit(False))
        return F.struct((-version).alias("version"), (~c["from_cna"]).alias("adp"),
                        secondary.alias("secondary"), i.alias("i"), c.alias("c"))

    scored = F.filter(F.transform(cvss, ranked), lambda r: r["c"]["base_score"].isNotNull())
    return F.array_min(scored)["c"]


def ssvc_options(options: Column) -> dict[str, Column]:
    """First value per decision point of an options list; keys compare in lower case."""
    entries = F.flatten(F.transform(options, F.map_entries))
    named = F.filter(entries, lambda e: e["value"].isNotNull())

    def first(match) -> Column:
        hits = F.filter(named, lambda e: match(F.lower(e["key"])))
        return F.try_element_at(hits, F.lit(1))["value"]

    return {"exploitation": first(lambda k: k == "exploitation"),
            "automatable": first(lambda k: k == "automatable"),
            "technical": first(lambda k: k.startswith("technical"))}


def cve_primary(parsed: DataFrame) -> DataFrame:
    """One denormalised row per record."""
    cna = F.try_element_at(F.filter("boxes", lambda b: b["from_cna"]), F.lit(1))["container"]
    english = F.filter(cna["descriptions"], lambda d: F.lower(d["lang"]).startswith("en"))
    weakness = F.filter("cwe", lambda w: F.upper(w["cwe_id"]).startswith("CWE-"))
    options = F.flatten(F.transform("boxes", lambda b: F.flatten(F.transform(
        F.filter(_list(b, "metrics", _METRIC), lambda m: m["other"]["type"] == "ssvc"),
        lambda m: F.coalesce(m["other"]["content"]["options"],
                             F.array().cast("array<map<string,string>>"))))))

    def tagged(word: str) -> Column:
        return F.exists("refs", lambda r: F.exists(
            F.coalesce(r["tags"], F.array().cast("array<string>")), lambda t: F.lower(t) == word))

    ssvc = ssvc_options(F.col("options"))
    rows = compute_once(parsed, best=primary_cvss(F.col("cvss")), options=options)
    best = F.col("best")
    return rows.select(
        "cve_id", F.try_element_at(english, F.lit(1))["value"].alias("description_en"),
        best["version"].alias("primary_cvss_version"),
        best["base_score"].alias("primary_cvss_score"),
        best["base_severity"].alias("primary_cvss_severity"),
        best["vector"].alias("primary_cvss_vector"),
        F.upper(F.try_element_at(weakness, F.lit(1))["cwe_id"]).alias("primary_cwe"),
        tagged("exploit").alias("has_exploit_ref"), tagged("patch").alias("has_patch_ref"),
        ssvc["exploitation"].alias("ssvc_exploitation"),
        ssvc["automatable"].alias("ssvc_automatable"),
        ssvc["technical"].alias("ssvc_technical_impact"))


def enrich_due(published: DataFrame, full: bool = False) -> DataFrame:
    """Records to parse: never done, changed since, or stamped although nothing was read.

    Rows without JSON are left out and stay unstamped until their record lands.
    """
    rows = published.where(F.col("raw_json").isNotNull())
    if full:
        return rows
    empty = (F.col("state") == "PUBLISHED") & F.col("enriched_at").isNotNull() & F.coalesce(
        F.col("description_en"), F.col("primary_cvss_score").cast("string"),
        F.col("primary_cwe")).isNull()
    return rows.where(F.col("enriched_at").isNull()
                      | (F.col("cvelist_updated_at") > F.col("enriched_at")) | empty)


def enrich(published: DataFrame, full: bool = False) -> dict[str, DataFrame]:
    """All child tables and the primary row of the records that are due.

    The parsed arrays are written once; each output reads the columns it needs.
    """
    due = enrich_due(published, full).select(F.col("id").alias("cve_id"),
                                             F.col("raw_json").alias("raw"))
    parsed = cut_lineage(parse_records(due))
    return {"cve_cvss": cve_cvss(parsed), "cve_cwe": cve_cwe(parsed), "cve_cpe": cve_cpe(parsed),
            "cve_reference": cve_reference(parsed), "primary": cve_primary(parsed)}


def nvd_window_chunks(spans: DataFrame, start: str, end: str, days: int = 120) -> DataFrame:
    """Split each [start, end) into windows of at most ``days`` days."""
    step = F.make_dt_interval(F.lit(days))
    opened = F.when(F.col(start) < F.col(end), F.sequence(start, end, step))
    kept = [c for c in spans.columns if c not in (start, end)]
    return (spans.select(*kept, F.col(end).alias("_end"), F.explode(opened).alias("chunk_start"))
            .where(F.col("chunk_start") < F.col("_end"))
            .select(*kept, "chunk_start",
                    F.least(F.col("chunk_start") + step, F.col("_end")).alias("chunk_end")))
