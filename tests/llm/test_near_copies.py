"""Near copies against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from advisorylake.llm import near_copies


def plain_survivors(rows):
    """Smallest id of each group, by exact similarity of all pairs."""
    sets = []
    for _, text in rows:
        words = [w.lower() for w in (text or "").split()]
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(least.values())


def corpus(seed):
    """Lone texts, a large group of near copies, groups on both sides of 0.8, chains, a common line, short texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    line = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 90))) + rnd.choice(["", " " + line]) for _ in range(80)]
    for size, edits, copies in [(200, 3, 60), (120, 4, 12), (60, 1, 20), (9, 1, 10), (8, 0, 3)]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                words[rnd.randrange(size)] = word()
            texts.append(" ".join(words))
    chain = [word() for _ in range(100)]
    texts += [" ".join(chain[i:i + 50]) for i in range(0, 50, 5)]
    texts += [" ".join(chain[:k]) for k in range(1, 14)] + [None, "", " \t", "One two", "one TWO", "a a a a a a a", "a a a a a"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_all_pairs(spark, seed, monkeypatch):
    if seed == 3:  # most shingles are of unknown frequency
        monkeypatch.setattr(near_copies, "COMMON", 20)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.survivors(docs).collect()) == plain_survivors(rows)


def test_stage_joins_what_differs_in_more_than_two_bits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted({r.doc_id: r.text for r in docs.collect()}.items())
    base = [f"v{i}" for i in range(120)]
    rows += [(10**9 + k, " ".join(base[:25 * k] + [f"x{k}"] + base[25 * k + 1:])) for k in range(1, 5)]
    frame = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, sf_dir).collect())
    assert got == plain_survivors(rows) and [i for i in got if i > 10**9] == [10**9 + 1]


def test_shared_passages_make_few_candidates(spark, monkeypatch):
    """Ten passages, each in a tenth of the documents: candidate pairs grow no faster than documents."""
    kept = {}
    write = near_copies.Scratch.write

    def counting(self, df, name):
        out = write(self, df, name)
        kept[name] = out.count() if name in ("tried", "left") else None
        return out

    monkeypatch.setattr(near_copies.Scratch, "write", counting)
    pairs = []
    for n in (500, 2000):
        rnd = random.Random(n)
        word = lambda: f"w{rnd.randrange(100_000)}"
        passages = [" ".join(word() for _ in range(30)) for _ in range(10)]
        rows = [(i, " ".join(word() for _ in range(30)) + " " + passages[i % 10] + " " + " ".join(word() for _ in range(20))) for i in range(n)]
        near_copies.survivors(spark.createDataFrame(rows, "doc_id long, text string"))
        pairs.append(kept["tried"] + kept["left"])
    assert pairs[1] <= max(4 * pairs[0], 2000)


def written(monkeypatch):
    """What survivors writes, by name: (the frame's plan, its rows)."""
    kept = {}
    write = near_copies.Scratch.write

    def noting(self, df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = write(self, df, name)
        kept[name] = (plan, [tuple(r) for r in out.collect()] if name in ("near-pairs", "near", "tried") else None)
        return out

    monkeypatch.setattr(near_copies.Scratch, "write", noting)
    return kept


def test_close_copies_are_linked_by_fingerprint_tables(spark, monkeypatch):
    """Copies with another last word differ in few bits: the tables find them, and the prefix join has no need to."""
    rnd = random.Random(5)
    bases = [" ".join(f"w{rnd.randrange(50_000)}" for _ in range(400)) for _ in range(30)]
    rows = [(2 * i + k, f"{t} end{k}") for i, t in enumerate(bases) for k in (0, 1)]
    kept = written(monkeypatch)
    got = sorted(r.doc_id for r in near_copies.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [2 * i for i in range(30)] == plain_survivors(rows)
    near, tried = set(kept["near"][1]), set(kept["tried"][1])
    assert len(near) >= 15 and near <= {(i, i + 1) for i in got}
    assert not near & tried and near | tried == {(i, i + 1) for i in got}


def test_pairs_of_fingerprint_tables_are_verified(spark, monkeypatch):
    """With a radius of all bits every pair is a candidate; only those of similarity 0.8 link."""
    kept = written(monkeypatch)
    rows = [(i, t) for i, t in corpus(4) if i % 6 == 0]
    monkeypatch.setattr(near_copies.simhash, "links", lambda fps, radius, segments, scratch: fps.alias("x").join(
        fps.alias("y")).where("x.fp < y.fp").selectExpr("x.fp AS a", "y.fp AS b"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.survivors(docs).collect()) == plain_survivors(rows)
    assert len(kept["near-pairs"][1]) > 5 * len(kept["near"][1]) > 0


def test_sets_of_candidates_shuffle_no_text(spark, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    kept = written(monkeypatch)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_copies.survivors(spark.createDataFrame(corpus(1)[:60], "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for name in ("near-sets", "links-sets", "more-sets"):
        read, ids = kept[name][0].split("Bucketed: true")
        assert "Exchange" not in read and "Exchange" in ids
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_empty_table(spark):
    out = near_copies.survivors(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id"] and out.count() == 0
