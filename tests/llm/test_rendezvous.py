"""Shards against a plain rendezvous hash, slots, and what a new shard moves."""

from __future__ import annotations

import math
import zlib

import pytest
import xxhash

from advisorylake.llm import rendezvous as rv
from advisorylake.session import Scratch

DOC = "doc_id long, text string, shard string, slot int"


def plain(key, weights):
    times = []
    for s, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(f"{key}:{s}".encode(), seed=42) >> 11
        times.append((-math.log((h + 0.5) / 2**53) / w, s))
    return min(times)[1]


@pytest.mark.parametrize("weights", [(1.0,) * 24, (1.0, 3.0, 0.5)])
def test_matches_the_plain_hash(spark, weights):
    rows = [(i, f"text {i} é" * (i % 5), "x", 1) for i in range(2000)]
    rows += [(None, "a", "x", 1), (5, "again", "x", 1), (7, None, "x", 1), (7, None, "x", 1), (9000, "w " * 100_000, "x", 1)]
    out = rv.assign(spark.createDataFrame(rows, DOC), weights, rows_per_bucket=10).collect()
    assert len(out) == len(rows)
    for r in out:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == plain(key, weights)
        assert r.grown_shard == plain(key, (*weights, 1.0)) and r.grown_shard in (r.shard, len(weights))
    texts = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == texts
    for s in range(len(weights)):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_shares_follow_the_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    n = {r.shard: r["count"] for r in rv.assign(docs, (1.0, 3.0)).groupBy("shard").count().collect()}
    assert abs(n[1] / 20_000 - 0.75) < 0.02


def test_order_of_rows_changes_nothing(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('t', id % 7) AS text")
    a, b = (sorted(map(tuple, rv.assign(d, rows_per_bucket=5).collect())) for d in (docs, docs.orderBy("text").repartition(7)))
    assert a == b


def test_bad_weights_and_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    assert rv.assign(docs).count() == 0
    with pytest.raises(ValueError):
        rv.assign(docs, (1.0, 0.0))


def test_equal_rows_are_numbered_in_parts(spark):
    """A third of the rows without id and text: no numbering task gets them all, and slots follow from content."""
    rows = [(None, None)] * 3000 + [(i, f"text {i % 7}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = rv.assign(docs, rows_per_bucket=100)
    scratch = Scratch(spark, "test")
    written = scratch.write(placed.select(placed["doc_id"].alias("id"), "text_crc32", "size", "shard"), "placed")
    groups = rv.slot_groups(written, 24, 100, scratch)
    assert groups.count() == len(rows)
    assert groups.groupBy("shard", "bucket", "part").count().agg({"count": "max"}).first()[0] < 400

    got = [tuple(r) for r in placed.select("shard", "slot", "doc_id").collect()]
    slots = {}
    for shard, slot, _ in got:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = rv.assign(docs.repartition(5), rows_per_bucket=100).select("shard", "slot", "doc_id").collect()
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in again)
