"""Repository names inside URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_REPO_URL = (r"(?U)(?:^|(?<=[^\w.-]))(?:https?://)?(?:www\.)?github\.com/"
             r"([A-Za-z0-9][\w.-]*)/([A-Za-z0-9][\w.-]*)")
# First path segments of the host that are not repository owners.
NOT_OWNERS = [
    "advisories", "sponsors", "marketplace", "orgs", "users", "about", "security", "blog",
    "features", "topics", "collections", "apps", "notifications", "settings", "pulls",
    "issues", "login", "join", "site", "enterprise", "readme", "search", "gist",
]
# Fixed value: names that give away a proof-of-concept or disclosure repository.
_POC_NAME = (r"(?i)CVE-\d{4}-\d+|(?:^|[-_/])(?:pocs?|exploits?|disclosures?"
             r"|advisor(?:y|ies)|writeups?)(?:[-_/]|$)")
# Scan priority by the way a repository was found.
ORIGIN_PRIORITY = {"reference": 10, "past_cve": 20, "criticality": 15, "downloads": 15,
                   "top_n": 0, "manual": 30}


def extract_repo(url: Column) -> Column:
    """``owner/repo`` when the URL is on the exact host, else null."""
    owner = F.regexp_extract(url, _REPO_URL, 1)
    repo = F.regexp_replace(F.regexp_extract(url, _REPO_URL, 2), r"\.git$", "")
    usable = ((owner != "") & ~F.lower(owner).isin(NOT_OWNERS)
              & (repo != "") & ~repo.isin(".", ".."))
    return F.when(usable, F.concat(owner, F.lit("/"), repo))


def classify_repo_kind(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")).rlike(_POC_NAME), "poc").otherwise("project")


def origin_priority(origin: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ORIGIN_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, origin), F.lit(0))
