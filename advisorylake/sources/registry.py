"""Source registry: metadata rows and the scan that turns a landing into mentions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from advisorylake.sources import exploited, feeds, github, osv, vendors

HOUR = 3600


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    method: str
    tier: int
    cadence_seconds: int
    scan: Callable[..., DataFrame]


REGISTRY: dict[str, Source] = {}


def register(source: Source) -> Source:
    if not source.name:
        raise ValueError("a source needs a name")
    if source.name in REGISTRY:
        raise ValueError(f"source {source.name!r} registered twice")
    REGISTRY[source.name] = source
    return source


# Name, method, tier and cadence of every source.
for _row in [
    Source("cisa_kev", "known exploited list", "api", 1, HOUR, exploited.scan_cisa_kev),
    Source("vulncheck_kev", "known exploited list", "api", 1, HOUR, exploited.scan_vulncheck_kev),
    Source("certcc_vu", "vulnerability notes feed", "rss", 1, HOUR, feeds.scan_feed_entries),
    Source("redhat_csaf", "vendor CVE list", "api", 2, HOUR, vendors.scan_redhat),
    Source("cisco_psirt", "vendor advisories", "api", 2, HOUR, vendors.scan_cisco),
    Source("jenkins_security", "vendor advisory pages", "rss", 2, 12 * HOUR, feeds.scan_jenkins),
    Source("github_repo_advisories", "per-repository advisories and releases", "api", 2, HOUR,
           github.scan_repo_advisories),
    Source("exploitdb", "exploit archive", "api", 3, 6 * HOUR, exploited.scan_exploitdb),
    Source("wordfence", "plugin vulnerabilities", "api", 3, 24 * HOUR, vendors.scan_wordfence),
    Source("nessus", "plugin listing", "scrape", 3, 2 * HOUR, feeds.scan_plugin_listing),
    Source("metasploit", "exploit framework commits", "git", 3, HOUR, github.scan_gitlog),
    Source("nuclei_templates", "scan template commits", "git", 3, HOUR, github.scan_gitlog),
    Source("poc_in_github", "exploit repository index", "git", 3, 12 * HOUR,
           exploited.scan_poc_index_json),
    Source("trickest_cve", "exploit repository index", "git", 3, 12 * HOUR,
           exploited.scan_poc_index_md),
    Source("osv", "ecosystem advisories", "api", 4, 6 * HOUR, osv.scan_osv),
    Source("github_advisories", "global advisory list", "api", 4, HOUR, github.scan_ghsa),
    Source("github_commits", "commit logs of watched repositories", "git", 4, HOUR,
           github.scan_gitlog),
    Source("gemnasium", "curated advisory records", "git", 4, 12 * HOUR, vendors.scan_gemnasium),
    Source("kernel_cve", "kernel announcements", "rss", 4, HOUR, feeds.scan_kernel_cve),
    Source("thehackernews", "news feed", "rss", 5, HOUR // 2, feeds.scan_news),
]:
    register(_row)

# Generic feeds and their tier; one scan serves them all.
for _name, _tier in [
    ("zdi_published", 1), ("zdi_upcoming", 1), ("certeu", 1), ("siemens_cert", 2),
    ("paloalto", 2), ("spring_security", 2), ("fortiguard_psirt", 2), ("msrc", 2),
    ("fulldisclosure", 3), ("oss_security", 3), ("veeam", 2), ("zdi_blog", 5),
]:
    register(Source(_name, "advisory feed", "rss", _tier, HOUR, feeds.scan_feed_entries))


def registry_frame(spark: SparkSession) -> DataFrame:
    """The registry as rows of the ``sources`` dimension; its size is the code's."""
    rows = [(s.name, s.kind, s.method, s.tier, s.cadence_seconds) for s in REGISTRY.values()]
    return spark.createDataFrame(
        rows, "name string, kind string, method string, tier int, cadence_seconds int")
