"""Literal scenarios with known answers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from advisorylake.functions import dates as D
from advisorylake.operators import predicates as Q
from advisorylake.operators.leads import days_ahead, reconcile_leads
from advisorylake.params import Params
from advisorylake.plans import lists as L
from advisorylake.plans import reports as R

UTC = dt.timezone.utc
NOW = dt.datetime(2026, 7, 20, 12, tzinfo=UTC)
P = Params(as_of=NOW)
CAND = ("id string, cve_id string, merged_into string, status string, withdrawn boolean, "
        "in_kev boolean, has_public_poc boolean, severity_hint string, vuln_type string, "
        "first_seen_at timestamp, last_seen_at timestamp")


def candidate(cid, cve=None, merged=None, seen=NOW, kev=None, poc=None):
    return (cid, cve, merged, "candidate", None, kev, poc, None, None, seen, seen)


@pytest.fixture(scope="module")
def world(spark):
    published = spark.createDataFrame([
        ("CVE-2026-0001", "PUBLISHED", NOW, NOW), ("CVE-2026-0002", "PUBLISHED", None, NOW),
        ("CVE-2026-0005", "REJECTED", None, NOW)],
        "id string, state string, nvd_published_at timestamp, cvelist_published_at timestamp")
    rows = [
        candidate("published", "CVE-2026-0001"), candidate("pend_cvelist", "CVE-2026-0002"),
        candidate("pend_norow", "CVE-2026-0003", kev=True), candidate("precve", poc=True),
        candidate("malware"), candidate("rejected", "CVE-2026-0005"),
        candidate("no_product", "CVE-2026-0004"),
        candidate("tombstone", "CVE-2026-0003", merged="pend_norow"),
        candidate("old", seen=dt.datetime(2025, 12, 31, tzinfo=UTC), kev=True),
        candidate("stale", "CVE-2019-9999", kev=True, poc=True),
    ]
    affected = spark.createDataFrame(
        [(c, p, k, None) for c, p, k in [
            ("published", "acme", "product"), ("pend_cvelist", "acme", "product"),
            ("pend_norow", "widget_lib", "product"), ("precve", "acme", "product"),
            ("malware", "evil-pkg", "malware"), ("rejected", "acme", "product"),
            ("tombstone", "widget_lib", "product"), ("old", "legacy", "product"),
            ("stale", "stale-lib", "product")]],
        "candidate_id string, product string, kind string, ecosystem string")
    candidates = spark.createDataFrame(rows, CAND)
    facts = Q.candidate_facts(candidates, published, affected, P)
    return {"candidates": candidates, "published": published, "affected": affected, "facts": facts}


def as_dict(df):
    return {(r["dim"], r["key"]): r["n"] for r in df.collect()}


def test_pending_totals(world):
    got = as_dict(R.pending_metrics(world["facts"], world["affected"]))
    assert got == {("total", ""): 3, ("kind", "product"): 3, ("maturity", "pre_cve"): 1,
                   ("maturity", "cve_prereserved"): 1, ("maturity", "cve_reserved"): 1}


def test_pending_ranking(world):
    top = R.pending_top(world["facts"], world["affected"], "product", 10).collect()
    assert [tuple(r) for r in top] == [("acme", 2), ("widget_lib", 1)]


def test_breakdown_without_ecosystem(world):
    got = as_dict(R.pending_breakdown(world["facts"], world["affected"]))
    assert got[("eco", "(sin ecosistema)")] == 3


def test_both_pending_forms_agree(world):
    by_joins = Q.pending_base(world["candidates"], world["published"], world["affected"])
    by_flags = world["facts"].where("pending_base")
    assert sorted(r.id for r in by_joins.collect()) == sorted(r.id for r in by_flags.collect())


def test_historical_rows_stay_out(world):
    f = world["facts"]
    assert {r.id for r in f.where("pending_base AND NOT pending").collect()} == {"old", "stale"}
    assert {r.id for r in f.where(F.col("pending_base") & Q.old_cve_identifier(P)).collect()} == {"stale"}


def test_maturity_sums_to_pending_per_period(world):
    for row in R.trend_series(world["facts"], world["published"], world["affected"], P).collect():
        assert row.pre_published == row.pre_cve + row.cve_prereserved + row.cve_reserved


def test_trend_current_month(world):
    rows = {r.period: r for r in R.trend_series(
        world["facts"], world["published"], world["affected"], P, "month", 12).collect()}
    assert rows["2026-07"].pre_published == 3


def test_critical_needs_a_signal_and_orders_by_score(spark, world):
    cvss = spark.createDataFrame([], "candidate_id string, base_score double")
    mentions = spark.createDataFrame([], "candidate_id string, source_id int")
    sources = spark.createDataFrame([], "id int, name string, tier int")
    rows = L.pending_critical(world["facts"], cvss, mentions, sources, world["affected"], 10).collect()
    assert [r.id for r in rows] == ["pend_norow", "precve"]
    assert [r.score for r in rows] == [51.0, 21.0]


def test_wildcards_are_literal(spark):
    affected = spark.createDataFrame([("a", "100%beef", "product"), ("b", "100beef", "product")],
                                     "candidate_id string, product string, kind string")
    assert [r.candidate_id for r in Q.matching_products(affected, tech="0%b").collect()] == ["a"]
    assert Q.like_escape("50%_x\\") == "%50\\%\\_x\\\\%"


def test_lag_medians(spark):
    leads = spark.createDataFrame([(1,), (5,), (50,), (10,), (None,)], "days_ahead_vs_nvd_present int")
    row = R.lag_histogram(leads).first()
    assert (row.n, row.median, row.p90) == (4, 7.5, 38.0)
    assert sum(row[f"bin_{i}"] for i in range(7)) == row.n
    more = leads.union(spark.createDataFrame([(100,)], "x int"))
    assert R.lag_histogram(more).first().median == 10.0


def test_queue_medians(spark):
    rows = []
    for i, (age, cve) in enumerate([(3, None), (20, None), (200, None), (10, "CVE-2026-1"), (190, "CVE-2026-2")]):
        rows.append((str(i), cve, True, NOW - dt.timedelta(days=age)))
    rows.append(("x", None, True, dt.datetime(1980, 1, 1, tzinfo=UTC)))
    facts = spark.createDataFrame(rows, "id string, cve_id string, pending boolean, first_seen_at timestamp")
    got = {r.grp: (r.total, r.median_days) for r in R.queue_age(facts, None, None, P, False).collect()}
    assert got == {"unassigned": (3, 20.0), "assigned": (2, 100.0)}


def test_iso_week_bounds_and_bad_period():
    start, end = D.period_bounds("2026-W29", "week")
    assert start == dt.datetime(2026, 7, 13, tzinfo=UTC) and end - start == dt.timedelta(days=7)
    assert D.period_bounds("2026-12", "month")[1] == dt.datetime(2027, 1, 1, tzinfo=UTC)
    for bad in ("2026-13", "2026", "x"):
        with pytest.raises(ValueError):
            D.period_bounds(bad, "month")
    with pytest.raises(ValueError):
        D.since_cutoff("7y", NOW)


def test_unknown_maturity_is_an_error(world):
    with pytest.raises(ValueError):
        R.pending_rows(world["facts"], world["affected"], maturity="soon")


def test_half_even_days_and_promotion(spark):
    seen = dt.datetime(2026, 1, 1, tzinfo=UTC)
    cands = spark.createDataFrame([
        ("a", "CVE-2026-1", None, "emerging", seen), ("b", "CVE-2026-2", None, "emerging", seen),
        ("c", "CVE-2026-3", None, "candidate", seen)],
        "id string, cve_id string, merged_into string, status string, first_seen_at timestamp")
    day = dt.timedelta(days=1)
    pub = spark.createDataFrame([
        ("CVE-2026-1", seen + 7 * day, seen + 7 * day, None),
        ("CVE-2026-2", seen + 2.5 * day, seen + 60 * day, None), ("CVE-2026-3", None, None, None)],
        "id string, nvd_published_at timestamp, nvd_first_observed_at timestamp, "
        "nvd_first_analyzed_observed_at timestamp")
    got = {r.id: r for r in days_ahead(cands, pub).collect()}
    assert got["a"].days_ahead_vs_nvd_present == 7
    assert got["b"].days_ahead_vs_nvd_published == 2 and got["b"].days_ahead_vs_nvd_present is None
    changed = {r.id: r.status for r in reconcile_leads(cands, pub, NOW).collect()}
    assert changed == {"a": "published", "b": "published"}


def test_detail_by_cve_skips_tombstones_but_id_reaches_them(spark, world):
    empty = spark.createDataFrame([], "candidate_id string, scheme string, value string, version string, "
                                      "provenance string, base_score double, seen_at timestamp, source_id int, id long")
    epss = spark.createDataFrame([], "cve_id string, scored_date date, score double")
    sources = spark.createDataFrame([], "id int, name string")
    kw = dict(candidates=world["candidates"], identifiers=empty, cvss=empty, affected=world["affected"],
              mentions=empty, sources=sources, epss=epss, p=P)
    assert [r.id for r in L.candidate_detail("cve-2026-0003", **kw)["candidate"].collect()] == ["pend_norow"]
    assert [r.id for r in L.candidate_detail("tombstone", **kw)["candidate"].collect()] == ["tombstone"]
