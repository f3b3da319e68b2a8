"""Ingestion in many batches against one batch and against a plain union-find; crashes, replays and what a batch reads."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from advisorylake.operators.store import IngestStore, StoredForest
from advisorylake.operators.versioned import BUCKET
from advisorylake.schemas import MENTION_SCHEMA
from advisorylake.session import Scratch

ITEM = "product vendor ecosystem purl kind exact_versions ranges".split()


def mention(arrival, source, cve=None, native=None, extra=None, title="t", product=None):
    row = dict.fromkeys(f.name for f in MENTION_SCHEMA)
    item = product and [{**dict.fromkeys(ITEM), "product": product, "vendor": "v", "ecosystem": "npm", "kind": f"k{arrival}"}]
    return {**row, "url": f"https://x.example/{title}", "title": title, "snippet": "s", "cve_id": cve, "native_id": native, "extra_ids": extra,
            "affected": item, "source_id": source, "arrival": arrival}


def frame(spark, rows):
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = StructType([*MENTION_SCHEMA, StructField("source_id", IntegerType()), StructField("arrival", LongType())])
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def corpus(n):
    rnd = random.Random(n)
    cve = lambda: f"CVE-2024-{rnd.randrange(n) + 1000:04d}"
    zdi = lambda: f"ZDI-24-{rnd.randrange(n) + 100}"
    out = []
    for i in range(n):
        kind = rnd.randrange(4)
        ids = [(cve(), None, None), (None, zdi(), None), (cve(), None, [zdi()]), (None, zdi(), [zdi()])][kind]
        out.append(mention(i, rnd.randrange(3), *ids, title=f"t{rnd.randrange(5)}", product=rnd.choice([None, "p", "q"])))
    return out


def plain(rows):
    """(id, mentions, sources) of the live candidates."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        ids = [f"I|CVE|{r['cve_id']}"] * bool(r["cve_id"]) + [f"I|ZDI|{z}" for z in [r["native_id"], *(r["extra_ids"] or [])] if z]
        r["anchor"] = ids[0]
        for x in ids:
            a, b = find(ids[0]), find(x)
            root[max(a, b)] = min(a, b)
    seen, out = set(), {}
    for r in rows:
        key = r["source_id"], r["cve_id"], r["native_id"] or (r["extra_ids"] or [None])[0], r["title"]
        if key not in seen:
            seen.add(key)
            n, sources = out.get(find(r["anchor"]), (0, set()))
            out[find(r["anchor"])] = n + 1, sources | {r["source_id"]}
    return sorted((hashlib.sha256(k.encode()).hexdigest(), n, len(s)) for k, (n, s) in out.items())


def state(store):
    scratch = Scratch(store.spark, "state")
    return {
        "candidates": sorted(map(tuple, store.candidates().select("id", "cve_id", "mention_count", "source_count", "first_arrival").collect()), key=repr),
        "components": sorted(map(tuple, store.forest.components(scratch).collect())),
        "mentions": sorted(map(tuple, store.tables["mentions"].read().select("source_id", "content_hash", "arrival").collect())),
        "products": sorted(map(tuple, store.products().select("candidate_id", "vendor", "product", "ecosystem").collect()))}


def test_batches_equal_one_batch_and_a_plain_union_find(spark, tmp_path):
    rows = corpus(90)
    one, many = (IngestStore.create(spark, f"{tmp_path}/{n}", 4) for n in ("one", "many"))
    assert one.ingest(frame(spark, rows), 0)
    for i in range(5):
        assert many.ingest(frame(spark, rows[18 * i:18 * (i + 1)]), i)
    want = state(one)
    assert state(many) == want
    assert [(c[0], c[2], c[3]) for c in want["candidates"]] == plain(rows)
    gone = {r.id: r.merged_into for r in many.tombstones().collect()}
    live = {c[0] for c in want["candidates"]}
    assert gone and not set(gone) & live and set(gone.values()) <= live
    before = {n: t.manifest().version for n, t in many.tables.items()}
    assert not many.ingest(frame(spark, rows[72:]), 4) and not many.ingest(frame(spark, rows[:18]), 0)
    assert {n: t.manifest().version for n, t in many.tables.items()} == before


def test_a_replay_after_a_crash_changes_nothing(spark, tmp_path, monkeypatch):
    rows = corpus(24)
    store, sound = (IngestStore.create(spark, f"{tmp_path}/{n}", 2) for n in ("s", "t"))
    sound.ingest(frame(spark, rows), 0)
    move, moved = store.journal.files.move, []

    def failing(source, to):
        moved.append("/manifests/" in to)
        if sum(moved) > 2:
            raise OSError("lost")
        move(source, to)

    monkeypatch.setattr(store.journal.files, "move", failing)
    with pytest.raises(OSError):
        store.ingest(frame(spark, rows), 0)
    monkeypatch.undo()
    again = IngestStore(spark, f"{tmp_path}/s")
    assert not again.ingest(frame(spark, rows), 0)
    assert state(again) == state(sound)


def test_a_small_batch_reads_its_neighbourhood(spark, tmp_path):
    store = IngestStore.create(spark, f"{tmp_path}/s", 64)
    links = spark.range(20_000).select(F.format_string("I|CVE|CVE-2024-%06d", "id").alias("node"), F.format_string("I|CVE|CVE-2024-%06d", F.col("id") - F.col("id") % 2).alias("root"))
    forest = StoredForest(store.tables["links"], store.tables["moves"])
    forest.links.upsert(links, lambda old, new: old.unionByName(new))
    edges = spark.createDataFrame([("I|CVE|CVE-2024-000003", "I|CVE|CVE-2024-000009")], "a string, b string")
    scratch = Scratch(spark, "test")
    placed, moved, pending = forest.stage(edges, edges.select("a"), scratch)
    assert sorted(map(tuple, placed.collect())) == [(f"I|CVE|CVE-2024-00000{n}", "I|CVE|CVE-2024-000002") for n in (3, 9)]
    assert [tuple(r) for r in moved.collect()] == [("I|CVE|CVE-2024-000008", "I|CVE|CVE-2024-000002")]
    assert len(pending["links"].touched) <= 2 and len(pending["moves"].touched) == 1
    read = {f.split(f"{BUCKET}=")[1].split("/")[0] for f in forest.links.lookup(edges.select(F.col("a").alias("node"))).inputFiles() if BUCKET in f}
    assert len(read) == 1
    for name, p in pending.items():
        store.tables[name].publish(p)
    roots = {r.node: r.root for r in forest.components(scratch).where("node like '%00000_'").collect()}
    assert roots["I|CVE|CVE-2024-000008"] == roots["I|CVE|CVE-2024-000002"] == "I|CVE|CVE-2024-000002"
