"""The automaton against edit distances; learned parts and held-out accuracy on invented text."""

from __future__ import annotations

import inspect
import random
import zlib

import pytest

from advisorylake.llm import lexicon as lx

DOC = "doc_id long, text string, score string, stem int"
LABEL = "doc_id long, quality int, toxic int"


def edits_to_beginnings(stem, word):
    row = list(range(len(word) + 1))
    for i, x in enumerate(stem):
        new = [i + 1]
        for j, y in enumerate(word):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(3))
def test_automaton_is_the_edit_distance(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        trie = lx.Trie({"".join(rnd.choices("abé", k=rnd.randrange(4, 8))) for _ in range(6)})
        for _ in range(60):
            word = "".join(rnd.choices("abéd", k=rnd.randrange(0, 12)))
            costs = [(d, -len(s)) for s in trie.stems for d in [edits_to_beginnings(s, word)]
                     if d == 0 or (d == 1 and len(s) >= lx.FUZZY_LENGTH)]
            found = trie.find(word)
            assert (found and (found[1], -len(trie.stems[found[0]]))) == (min(costs) if costs else None)
            assert trie.possible(word) or not costs


def corpus(n=900):
    """A third toxic: an insult, at times misspelt. Others quote it with a mark and a reporting word."""
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("lor", "nes", "pid") for c in ("", "a", "en", "os")]
    spelt = ["grumblefrop", "grumbelfrop", "grumblefrob", "gruumblefrop", "grumblefropish"]
    rows, labels = [], []
    for i in range(n):
        text = rnd.choices(words, k=rnd.randrange(20, 80))
        if i % 3 == 0:
            text.insert(rnd.randrange(len(text)), rnd.choice(spelt))
        elif i % 3 == 1 and i % 2:
            text.insert(rnd.randrange(len(text)), '“grumblefrop” reportedly')
        rows.append((i, " ".join(text), "x", 1))
        if i % 5 != 2:
            labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus()
    out = lx.toxicity(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out]
    wrong = [r.doc_id for r in held if r.predicted != int(r.doc_id % 3 == 0)]
    assert len(held) > 100 and len(wrong) <= 0.03 * len(held)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, DOC)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in lx.toxicity(docs, spark.createDataFrame(x, LABEL)).collect()} for x in (labels, flipped))
    assert a == b


def test_edge_rows_and_missing_labels(spark):
    rows, labels = corpus(200)
    odd = [(None, rows[0][1], "x", 1), (1000, None, "x", 1), (1001, "", "x", 1), rows[3], (1002, "la " * 60_000 + "grumblefrop", "x", 1)]
    docs, marks = spark.createDataFrame(rows + odd, DOC), spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None), (0, 1, 1)], LABEL)
    out = lx.toxicity(docs, marks)
    assert out.count() == len(rows) + len(odd)
    assert {r.predicted for r in out.where("doc_id IN (1000, 1001)").collect()} == {0}
    assert out.where("doc_id = 1002").first().predicted == 1
    assert lx.toxicity(docs.limit(0), marks).count() == 0
    assert {r.predicted for r in lx.toxicity(docs, marks.limit(0)).collect()} == {0}
    assert {r.predicted for r in lx.toxicity(docs, marks.where("toxic = 1")).collect()} == {1}


def test_learns_from_twenty_thousand_labelled_rows():
    assert inspect.signature(lx.toxicity).parameters["labelled_rows"].default >= 20_000
