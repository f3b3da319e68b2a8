"""Vocabulary clean-up of extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from advisorylake.functions.text import strip

# Accepted words per field; anything else becomes null.
ALLOWED = {
    "attack_vector": ["network", "adjacent", "local", "physical"],
    "attack_complexity": ["low", "high"],
    "privileges_required": ["none", "low", "high"],
    "user_interaction": ["none", "required"],
    "scope": ["unchanged", "changed"],
    "confidentiality": ["none", "low", "high"],
    "integrity": ["none", "low", "high"],
    "availability": ["none", "low", "high"],
}
MAX_POC_URLS = 20


def literal_normalise(field: str, value: Column) -> Column:
    word = F.lower(strip(value))
    return F.when(word.isin(ALLOWED[field]), word)


def clean_poc_urls(urls: Column) -> Column:
    """http(s) URLs with a host, distinct, at most twenty."""
    stripped = F.transform(urls, strip)
    good = F.filter(stripped, lambda u: u.rlike(r"(?i)^https?://[^/?#]"))
    return F.coalesce(F.slice(F.array_distinct(good), 1, MAX_POC_URLS),
                      F.array().cast("array<string>"))
