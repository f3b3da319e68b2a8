"""Canonical URLs and the content hash that makes a mention unique per source."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from advisorylake.functions.text import normalize_text, strip

# Query parameters that only track the reader.
TRACKING_PREFIXES = ["utm_", "mc_"]
TRACKING_EXACT = ["fbclid", "gclid", "ref", "source", "mkt_tok"]

_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _decode(c: Column) -> Column:
    # A stray percent sign stays literal instead of failing the whole value.
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    # Java keeps '*' and escapes '~'; form encoding per RFC 3986 does the reverse.
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _is_tracking(key: Column) -> Column:
    low = F.lower(key)
    hit = low.isin(TRACKING_EXACT)
    for prefix in TRACKING_PREFIXES:
        hit = hit | low.startswith(prefix)
    return hit


def canonical_url(url: Column) -> Column:
    """No fragment, no tracking parameters, sorted query, lower-case scheme and host."""
    clean = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(clean, _URI, 1))
    host = F.lower(F.regexp_extract(clean, _URI, 2))
    bare = F.regexp_replace(F.regexp_extract(clean, _URI, 3), "/+$", "")
    path = F.when(bare == "", "/").otherwise(bare)
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(clean, _URI, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~_is_tracking(p["k"])))
    query = F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    body = (
        F.when(host != "", F.concat(F.lit("//"), host, rooted))
        .when(path.startswith("//") | (scheme.isin("http", "https", "ftp", "file")
                                       & path.startswith("/")),
              F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    full = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        body,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(full)


def content_hash(*, cve: Column, native: Column, title: Column, snippet: Column,
                 url: Column) -> Column:
    """SHA-256 over the five normalised parts; volatile page content never enters."""
    blank = F.lit("")
    payload = F.concat_ws(
        "\u001f",
        F.upper(F.coalesce(cve, blank)), F.upper(F.coalesce(native, blank)),
        normalize_text(title), normalize_text(snippet), canonical_url(url),
    )
    return F.sha2(payload, 256)
