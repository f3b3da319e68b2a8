"""Software names, ecosystems and kinds."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from advisorylake.functions.text import strip

# Ecosystem spelling -> canonical name.
ECOSYSTEM_ALIASES = {
    "pip": "pypi", "pypi": "pypi",
    "cargo": "crates.io", "rust": "crates.io", "crates": "crates.io",
    "crates.io": "crates.io",
    "go": "go", "golang": "go",
    "npm": "npm", "node": "npm",
    "maven": "maven", "nuget": "nuget",
    "gem": "rubygems", "rubygems": "rubygems",
    "composer": "packagist", "packagist": "packagist",
    "hex": "hex", "pub": "pub", "pub.dev": "pub", "hackage": "hackage",
}
# Ecosystems whose name starts so are distributions.
DISTRO_PREFIXES = [
    "ubuntu", "debian", "alpine", "rocky", "almalinux", "suse", "opensuse", "red hat",
    "redhat", "chainguard", "wolfi", "linux", "android", "bitnami", "mageia", "photon",
    "gentoo", "oracle",
]


def canonical_ecosystem(eco: Column) -> Column:
    key = F.lower(strip(eco))
    aliases = F.create_map(*[F.lit(x) for pair in ECOSYSTEM_ALIASES.items() for x in pair])
    return F.when(eco != "", F.coalesce(F.try_element_at(aliases, key), key))


def classify_kind(eco: Column, is_malware: Column | None = None) -> Column:
    key = F.lower(strip(F.coalesce(eco, F.lit(""))))
    distro = key.rlike("^(?:" + "|".join(DISTRO_PREFIXES) + ")")
    kind = F.when(distro, "distro").otherwise("product")
    return kind if is_malware is None else F.when(is_malware, "malware").otherwise(kind)


#: Bytes of text that are folded together, so that a worker holds few of a batch's values as Python objects.
FOLD_BYTES = 1 << 20


@F.arrow_udf(T.StringType())
def _fold_accents(values: pa.Array) -> pa.Array:
    parts, at = [], 0
    while at < len(values):
        n, rows = 0, []
        while at < len(values) and n < FOLD_BYTES:
            text = values[at].as_py()
            rows.append(None if text is None else unicodedata.normalize("NFKD", text).encode("ascii", "ignore"))
            n, at = n + len(rows[-1] or b""), at + 1
        parts.append(pa.array(rows, pa.binary()))
    return pa.concat_arrays(parts or [pa.array([], pa.binary())]).cast(pa.string())


def normalize_key(c: Column) -> Column:
    """Accent-free, lower-case key with single spaces between alphanumeric runs.

    Spark has no Unicode decomposition, so only values with non-ASCII characters visit
    the Arrow function; the rest of the column reaches it as nulls.
    """
    plain = c.rlike(r"^\p{ASCII}*$")
    folded = F.when(plain, c).otherwise(_fold_accents(F.when(~plain, c)))
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def osv_ranges(events: Column, version_type: Column) -> Column:
    """Version ranges of an event list: ``introduced`` opens, the others close.

    Folding keeps the events of one range in order; a single advisory range is small.
    """
    row = "struct<introduced:string,fixed:string,last_affected:string,version_type:string,raw:string>"
    none = F.lit(None).cast("string")
    start = F.struct(
        F.array().cast(f"array<{row}>").alias("done"),
        none.alias("intro"), none.alias("fixed"), none.alias("last"),
        F.lit(False).alias("is_open"),
    )

    def as_range(acc: Column) -> Column:
        return F.struct(
            acc["intro"].alias("introduced"), acc["fixed"].alias("fixed"),
            acc["last"].alias("last_affected"), version_type.alias("version_type"),
            none.alias("raw"))

    def step(acc: Column, ev: Column) -> Column:
        opens = ev["introduced"].isNotNull()
        flushed = F.when(opens & acc["is_open"],
                         F.concat(acc["done"], F.array(as_range(acc)))).otherwise(acc["done"])
        return F.struct(
            flushed.alias("done"),
            F.when(opens, ev["introduced"]).otherwise(acc["intro"]).alias("intro"),
            F.coalesce(ev["fixed"], F.when(~opens, acc["fixed"])).alias("fixed"),
            F.coalesce(ev["last_affected"], F.when(~opens, acc["last"])).alias("last"),
            (acc["is_open"] | opens | ev["fixed"].isNotNull()
             | ev["last_affected"].isNotNull()).alias("is_open"),
        )

    def finish(acc: Column) -> Column:
        filled = F.concat_ws("", acc["intro"], acc["fixed"], acc["last"]) != ""
        return F.when(acc["is_open"] & filled,
                      F.concat(acc["done"], F.array(as_range(acc)))).otherwise(acc["done"])

    folded = F.aggregate(F.coalesce(events, F.array().cast(
        "array<struct<introduced:string,fixed:string,last_affected:string>>")),
        start, step, finish)
    return folded


def gemnasium_ranges(text: Column) -> Column:
    """``>=1,<2||>=3,<4``: bars separate ranges, commas separate conditions."""
    none = F.lit(None).cast("string")

    def to_range(segment: Column) -> Column:
        conds = F.transform(F.split(segment, ","), strip)
        lows = F.filter(conds, lambda x: x.startswith(">"))
        highs = F.filter(conds, lambda x: x.startswith("<"))
        low = strip(F.regexp_replace(F.try_element_at(lows, F.lit(-1)), "^>=?", ""))
        high = strip(F.regexp_replace(F.try_element_at(highs, F.lit(-1)), "^[<=]+", ""))
        return F.struct(
            low.alias("introduced"), high.alias("fixed"), none.alias("last_affected"),
            none.alias("version_type"), strip(segment).alias("raw"))

    ranges = F.transform(F.split(text, r"\|\|"), to_range)
    return F.filter(ranges, lambda r: F.concat_ws("", r["introduced"], r["fixed"]) != "")
