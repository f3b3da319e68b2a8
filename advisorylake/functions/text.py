"""Small text and list helpers shared by the other builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim any Unicode whitespace at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_of(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def normalize_text(c: Column) -> Column:
    collapsed = F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.coalesce(F.lower(F.trim(collapsed)), F.lit(""))


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def sorted_cves(c: Column) -> Column:
    """Distinct CVE ids of a text, upper case, sorted."""
    return F.array_sort(F.array_distinct(find_all(F.upper(c), CVE_LOOSE)))


def join_present(sep: str, *cols: Column) -> Column:
    """Join the non-null, non-empty parts."""
    return F.concat_ws(sep, *[blank_to_null(c) for c in cols])


def empty_to_null(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def union_keep_order(mine: Column, theirs: Column, cap: int | None = None) -> Column:
    """Ordered array union, ours first."""
    blank = F.array().cast("array<string>")
    out = F.array_distinct(F.concat(F.coalesce(mine, blank), F.coalesce(theirs, blank)))
    return F.slice(out, 1, cap) if cap else out


# Fixed value: the unanchored CVE pattern used by most feeds.
CVE_LOOSE = r"CVE-[0-9]{4}-[0-9]{4,}"
