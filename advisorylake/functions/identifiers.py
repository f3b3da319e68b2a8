"""Vulnerability identifiers found in text, in priority order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from advisorylake.functions.text import bind, blank_to_null, find_all

# Scheme -> pattern, most specific meaning first. (?U) gives the word
# boundary and digit classes their Unicode meaning.
PATTERNS = [
    ("CVE", r"(?iU)\bCVE-\d{4}-\d{4,}\b"),
    ("ZDI-CAN", r"(?iU)\bZDI-CAN-\d{3,6}\b"),
    ("ZDI", r"(?iU)\bZDI-\d{2}-\d{3,5}\b"),
    ("VU", r"(?iU)\bVU#\d{5,7}\b"),
    ("GHSA", r"(?iU)\bGHSA-[23456789cfghjmpqrvwx]{4}-[23456789cfghjmpqrvwx]{4}"
             r"-[23456789cfghjmpqrvwx]{4}\b"),
    ("MSRC", r"(?iU)\bADV\d{6}\b"),
    ("GHCOMMIT", r"(?U)\bGHCOMMIT:[\w.-]+/[\w.-]+@[0-9a-fA-F]{7,40}\b"),
    ("OSV", r"(?U)(?<![\w-])(?:PYSEC-\d{4}-\d+|GO-\d{4}-\d+|RUSTSEC-\d{4}-\d{4}"
            r"|GSD-\d{4}-\d+|MAL-\d{4}-\d+|OSV-\d{4}-\d+)\b(?!-\d)"),
]
# Substrings without which the pattern of a scheme cannot match.
MARKERS = {
    "CVE": ["CVE-"], "ZDI-CAN": ["ZDI-CAN-"], "ZDI": ["ZDI-"], "VU": ["VU#"],
    "GHSA": ["GHSA-"], "MSRC": ["ADV"], "GHCOMMIT": ["GHCOMMIT:"],
    "OSV": ["PYSEC-", "GO-", "RUSTSEC-", "GSD-", "MAL-", "OSV-"],
}
# Fixed value: schemes that justify storing a mention. A bare commit anchor does not.
RECOGNIZED = ["CVE", "ZDI-CAN", "ZDI", "VU", "GHSA", "MSRC", "OSV"]


def canonical_value(scheme: str, value: Column) -> Column:
    if scheme == "GHSA":
        return F.concat(F.lit("GHSA-"), F.lower(F.substring(value, F.lit(6), F.length(value))))
    if scheme == "GHCOMMIT":
        return value
    return F.upper(value)


def _typed(scheme: str):
    return lambda v: F.struct(F.lit(scheme).alias("scheme"),
                              canonical_value(scheme, v).alias("value"))


def extract_identifiers(*texts: Column) -> Column:
    """array<struct<scheme,value>> over the newline-joined texts, distinct, in order.

    Most texts hold ids of one or two schemes. A plain substring test on the upper-cased
    text decides which patterns run at all.
    """
    blob = F.concat_ws("\n", *[blank_to_null(t) for t in texts])
    nothing = F.array().cast("array<string>")

    def search(b: Column) -> Column:
        per_scheme = []
        for scheme, pattern in PATTERNS:
            marks = [b["upper"].contains(mark) for mark in MARKERS[scheme]]
            may_match = reduce(lambda x, y: x | y, marks)
            found = F.when(may_match, find_all(b["text"], pattern)).otherwise(nothing)
            per_scheme.append(F.transform(found, _typed(scheme)))
        return F.array_distinct(F.flatten(F.array(*per_scheme)))

    return bind(F.struct(blob.alias("text"), F.upper(blob).alias("upper")), search)


def extract_from_list(values: Column, *texts: Column) -> Column:
    """Same over a list column plus single texts, texts first."""
    joined = F.concat_ws("\n", F.filter(values, lambda v: v != ""))
    return extract_identifiers(*texts, joined)


def primary_cve(ids: Column) -> Column:
    return F.try_element_at(F.filter(ids, lambda i: i["scheme"] == "CVE"), F.lit(1))["value"]


def primary_native(ids: Column) -> Column:
    return F.try_element_at(F.filter(ids, lambda i: i["scheme"] != "CVE"), F.lit(1))["value"]


def is_recognized(ids: Column) -> Column:
    return F.exists(ids, lambda i: i["scheme"].isin(RECOGNIZED))


def values_of(ids: Column, cve: bool) -> Column:
    """Recognised values, CVE ones or the others."""
    def keep(i: Column) -> Column:
        same = i["scheme"] == "CVE"
        return i["scheme"].isin(RECOGNIZED) & (same if cve else ~same)

    return F.transform(F.filter(ids, keep), lambda i: i["value"])
