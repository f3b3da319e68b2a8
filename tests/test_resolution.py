"""Components, tombstones, hot keys and the ingestion of a batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from advisorylake.operators import ingest as I
from advisorylake.operators import merge as M, resolve as RS
from advisorylake.schemas import MENTION_SCHEMA


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def graph(seed):
    """A chain, a hub with a third of all edges, random pairs, repeats and loops."""
    rnd = random.Random(seed)
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(500, 501 + i) for i in range(60)]
    pairs = [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    edges = chain + hub + pairs + hub[:5] + [(7, 7)]
    rnd.shuffle(edges)
    return [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in edges]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    edges = graph(seed)
    nodes = sorted({n for e in edges for n in e} | {9999})
    df = spark.createDataFrame(edges, "a long, b long")
    labels, rounds = RS.connected_components(df, spark.createDataFrame([(n,) for n in nodes], "n long"))
    got = {r.node: r.component for r in labels.collect()}
    assert labels.count() == len(nodes) and rounds <= 12
    assert got == union_find(edges, nodes)


def test_no_edges(spark):
    labels, rounds = RS.connected_components(
        spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(1,), (2,)], "n long"))
    assert rounds == 0 and sorted((r.node, r.component) for r in labels.collect()) == [(1, 1), (2, 2)]


def test_tombstone_chains_and_cycles(spark):
    rows = [("r", None)] + [(f"t{i}", f"t{i - 1}" if i else "r") for i in range(20)] + [("x", "y"), ("y", "x")]
    df = spark.createDataFrame(rows, "id string, merged_into string")
    got = {r.id: r.root for r in RS.follow_tombstones(df).collect()}
    assert all(got[f"t{i}"] == "r" for i in range(20)) and got["r"] == "r"
    assert got["x"] is None and len(got) == len(rows)


def owners(frames):
    return {r.value: r.candidate_id for r in frames["identifiers"].collect()}


@pytest.fixture(scope="module")
def batch(spark):
    from pyspark.sql import types as T

    schema = T.StructType([*MENTION_SCHEMA.fields, T.StructField("source_id", T.IntegerType()),
                           T.StructField("arrival", T.LongType())])

    def build(rows):
        return spark.createDataFrame(
            [tuple(({"source_id": 1, "arrival": i} | r).get(n) for n in schema.names)
             for i, r in enumerate(rows)], schema)

    return build


def test_prose_never_merges(batch):
    out = I.ingest(batch([
        {"cve_id": "CVE-2026-1000", "title": "fixes CVE-2026-1000 and CVE-2026-2000"},
        {"cve_id": "CVE-2026-2000", "title": "other"},
        {"title": "roundup CVE-2026-3000, CVE-2026-1000"}, {"title": "nothing here"},
        {"native_id": "GHCOMMIT:o/r@abcdef0"}]))
    own = owners(out)
    assert len(set(own.values())) == 3 and set(own) == {"CVE-2026-1000", "CVE-2026-2000", "CVE-2026-3000"}
    assert out["mentions"].count() == 3
    assert {(r.arrival, r.cve_id) for r in out["soft_references"].collect()} == {
        (0, "CVE-2026-2000"), (2, "CVE-2026-1000")}


def test_aliases_merge_and_ids_are_stable(batch):
    rows = [{"cve_id": "CVE-2026-7", "title": "a"}, {"cve_id": "CVE-2026-7777", "title": "a"},
            {"native_id": "GHSA-2345-6789-cfgh", "title": "b"},
            {"cve_id": "CVE-2026-7777", "extra_ids": ["GHSA-2345-6789-CFGH"], "title": "c"}]
    first = owners(I.ingest(batch(rows)))
    assert first["CVE-2026-7777"] == first["GHSA-2345-6789-cfgh"]
    assert owners(I.ingest(batch(list(reversed(rows))))) == first


def test_repeat_adds_no_row_but_still_adds_facts(batch):
    # The first non-CVE id is part of the hash; an alias of lower priority is not.
    same = {"cve_id": "CVE-2026-1000", "native_id": "GHSA-2345-6789-cfgh", "title": " A  b ",
            "url": "https://e.com/?utm_x=1"}
    out = I.ingest(batch([
        same, same | {"title": "a B", "url": "https://e.com/", "extra_ids": ["OSV-2026-9"],
                      "flags": {"in_kev": True, "kev_date": None, "kev_source": "cisa", "has_public_poc": None},
                      "reference_urls": [f"https://r/{i}" for i in range(60)]}]))
    assert out["mentions"].count() == 1
    assert set(owners(out)) == {"CVE-2026-1000", "GHSA-2345-6789-cfgh", "OSV-2026-9"}
    assert out["flags"].first().in_kev is True and out["flags"].first().has_public_poc is None
    assert len(out["updates"].first().reference_urls) == 50
    again = I.ingest(batch([same]), stored=out["mentions"])
    assert again["mentions"].count() == 0


def test_known_candidates_merge_into_the_winner(spark, batch):
    known = spark.createDataFrame([("CVE", "CVE-2026-1000", "A"), ("OSV", "OSV-2026-1", "B")],
                                  "scheme string, value string, candidate_id string")
    cands = spark.createDataFrame([("A", "CVE-2026-1000", "2026-02-01"), ("B", None, "2026-01-01")],
                                  "id string, cve_id string, d string").withColumn(
        "first_seen_at", F.col("d").cast("timestamp"))
    out = I.ingest(batch([{"cve_id": "CVE-2026-1000", "extra_ids": ["OSV-2026-1"]}]), known, cands)
    assert set(owners(out).values()) == {"A"}
    assert [(r.loser, r.winner) for r in out["merges"].collect()] == [("B", "A")]


def test_reassign_keeps_the_winners_row(spark):
    rows = spark.createDataFrame([("A", "3.1", 9.0), ("B", "3.1", 1.0), ("B", "4.0", 2.0)],
                                 "candidate_id string, version string, score double")
    roots = spark.createDataFrame([("A", "A"), ("B", "A")], "id string, root string")
    got = sorted(tuple(r) for r in RS.merge_reassign(rows, roots, ["version"]).collect())
    assert got == [("A", "3.1", 9.0), ("A", "4.0", 2.0)]


def test_merge_is_null_safe_and_idempotent(spark):
    schema = "candidate_id string, vendor string, product string, ecosystem string, kind string"
    target = spark.createDataFrame([("c", None, "p", None, "old")], schema)
    change = spark.createDataFrame([("c", None, "p", None, None), ("c", None, "p", "npm", "new")], schema
                                   ).withColumn("arrival", F.lit(1))
    once = M.merge_affected_structured(target, change)
    assert sorted(map(str, once.collect())) == sorted(map(str, M.merge_affected_structured(once, change).collect()))
    assert once.count() == 2 and once.where("kind = 'old'").isEmpty()


def test_tombstoned_owner_gives_way_to_its_live_candidate(spark, batch):
    known = spark.createDataFrame([("CVE", "CVE-2026-1000", "T"), ("OSV", "OSV-2026-1", "L")],
                                  "scheme string, value string, candidate_id string")
    cands = spark.createDataFrame([("T", "CVE-2026-1000", "2026-01-01", "L"), ("L", "CVE-2026-1000", "2026-02-01", None)],
                                  "id string, cve_id string, d string, merged_into string").withColumn(
        "first_seen_at", F.col("d").cast("timestamp"))
    out = I.ingest(batch([{"cve_id": "CVE-2026-1000", "extra_ids": ["OSV-2026-1"]}]), known, cands)
    assert set(owners(out).values()) == {"L"} and out["merges"].isEmpty()


def test_unknown_dates_come_last_in_every_merge_rule(spark):
    from advisorylake.operators.aggregates import merge_winner

    rows = spark.createDataFrame([(1, "a", "CVE-2026-1", None, "x", ["p"]), (1, "b", "CVE-2026-2", "2026-03-01", "y", ["p"])],
                                 "component int, id string, cve_id string, d string, vuln_type string, cwe_ids array<string>"
                                 ).withColumn("first_seen_at", F.col("d").cast("timestamp"))
    attached = rows.select("component", F.col("cve_id").alias("cve"), F.lit(1).alias("arrival"), F.lit(0).alias("ordinal"))
    assert merge_winner(rows).first().winner == "b"
    assert RS.merge_absorb(rows).first().winner == "b" and RS.merge_absorb(rows).first().vuln_type == "y"
    assert RS.candidate_cve(rows, attached).first().cve_id == "CVE-2026-2"
    assert RS.merge_absorb_lists(rows, "cwe_ids").first().first_use.rank.id == "b"


def test_unscored_vectors_never_win(spark):
    from advisorylake.operators.aggregates import cvss_selected
    from advisorylake.plans.lists import signal_ids

    rows = spark.createDataFrame([("c", "3.1", "authoritative", 9.8), ("c", "4.0", "authoritative", None), ("d", "4.0", "authoritative", None)],
                                 "candidate_id string, version string, provenance string, base_score double")
    assert {r.candidate_id: r.base_score for r in cvss_selected(rows).collect()} == {"c": 9.8, "d": None}
    cands = spark.createDataFrame([("d", None, False, False, None)],
                                  "id string, merged_into string, in_kev boolean, has_public_poc boolean, severity_hint string")
    assert [r.id for r in signal_ids(cands, rows).collect()] == ["c"]
    found = M.structured_cvss(spark.createDataFrame([("c", 1, ["CVSS:4.0/AV:N/AC:L/AT:N", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"])],
                                                    "candidate_id string, arrival int, cvss_vectors array<string>"))
    assert [r.version for r in found.collect()] == ["3.1"]


def test_candidate_lists_join_what_is_stored(spark):
    rows = spark.createDataFrame([
        ("c", 2, ["u2", "u1"], ["CWE-79"], None), ("c", 1, ["u3"], ["CWE-20", "CWE-1"], True), ("d", 3, None, None, False)],
        "candidate_id string, arrival int, reference_urls array<string>, cwe_ids array<string>, withdrawn boolean")
    stored = spark.createDataFrame([("c", ["u0", "u1"], ["CWE-1"]), ("other", ["u9"], None)],
                                   "candidate_id string, reference_urls array<string>, cwe_ids array<string>")
    got = {r.candidate_id: (r.withdrawn, r.reference_urls, r.cwe_ids) for r in I.candidate_updates(rows, stored, cap=None).collect()}
    assert got == {"c": (True, ["u0", "u1", "u3", "u2"], ["CWE-1", "CWE-20", "CWE-79"]), "d": (False, None, None)}
    assert {r.candidate_id: r.reference_urls for r in I.candidate_updates(rows, cap=2).collect()} == {"c": ["u3", "u2"], "d": None}


def test_ids_behind_the_snippet_survive(spark):
    from advisorylake.sources.feeds import scan_news, scan_plugin_listing

    text = "CVE-2024-1111 " + "x" * 3000 + " CVE-2024-2222"
    news = scan_news(spark.createDataFrame([("t", text, "l", None)], "title string, summary string, link string, seen_at timestamp"))
    row = f'<tr><td><a href="/plugins/nessus/1">Fix</a></td><td>{"y" * 3000} CVE-2024-3333</td></tr>'
    listing = scan_plugin_listing(spark.createDataFrame([(row,)], "raw string"))
    carry = lambda df: df.withColumns({"source_id": F.lit(1), "arrival": F.lit(1)})
    both = I.prepare(carry(news.unionByName(listing)))
    assert sorted(r.extracted_cve for r in both.collect()) == ["CVE-2024-1111", "CVE-2024-3333"]
    assert [r.cve_id for r in I.soft_references(both).collect()] == ["CVE-2024-2222"]
