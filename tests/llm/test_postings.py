"""Phrase and proximity search against a scan of all positions."""

from __future__ import annotations

import random
import re

import pytest

from advisorylake.llm import postings

VOCAB = ["the", "of", "a", "in", "zebra", "über", "x1", "42", "naïve"]


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)


def plain(docs, items, width, slop):
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, names, near = set(), set(), set()
        for name, item in items:
            v = words_of(item)
            size = min(width, len(v))
            for at in range(len(v) - size + 1 if size else 0):
                gram = v[at:at + size]
                for s in range(-slop, len(w)):
                    if s >= 0 and w[s:s + size] == gram:
                        hit |= set(range(s, s + size))
                        names.add(name)
                    elif slop and all(any(0 <= s + j + d < len(w) and w[s + j + d] == g for d in range(-slop, slop + 1))
                                      for j, g in enumerate(gram)):
                        near.add((name, tuple(gram), s))
        out.append((doc, len(w), sorted(hit), sorted(n for n in names if n is not None),
                    sorted({n for n, _, _ in near} - names - {None})))
    return out


def corpus(seed, n=30):
    rnd = random.Random(seed)
    items = [(str(i), " ".join(rnd.choices(VOCAB, k=rnd.choice([0, 2, 5, 9])))) for i in range(8)]
    items += [items[1], (None, "zebra 42 zebra"), ("n", None), ("z", "..."), ("10", "The, OF-a in")]
    docs = [(i, " ".join(rnd.choices(VOCAB, k=rnd.randrange(0, 40)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "THE of. a in!"), (None, "of a in zebra"), (3, docs[3][1])]
    docs += [(n + 9, "the of " * 3000 + (items[5][1] or "x"))]
    return docs, items


@pytest.mark.parametrize("test_bytes", [1 << 20, 60])
def test_exact_windows(spark, test_bytes):
    docs, items = corpus(5)
    d = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, block int, items string")
    t = spark.createDataFrame(items, "item_id string, text string")
    got = [(r.doc_id, r.n_words, sorted(p for s in r.spans for p in range(s.start, s.end)), r["items"], r.near_items)
           for r in postings.find_phrases(d, t, width=4, test_bytes=test_bytes).collect()]
    assert sorted(got, key=repr) == sorted(plain(docs, items, 4, 0), key=repr)


def test_proximity_needs_every_word_near_its_place(spark):
    docs = [(1, "zebra x1 of 42"), (2, "zebra of x1 42"), (3, "x1 zebra a a a 42"), (4, "zebra x1 of 42 the zebra of x1 42")]
    items = [("p", "zebra x1 of 42")]
    out = postings.find_phrases(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id string, text string"), width=4, slop=1)
    got = {r.doc_id: (r["items"], r.near_items) for r in out.collect()}
    assert got == {1: (["p"], []), 2: ([], ["p"]), 3: ([], []), 4: (["p"], [])}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    t = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert postings.contamination(d.limit(0), t).count() == 0
    row = postings.contamination(d, t.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_verdict_is_a_twentieth_of_the_words(spark):
    d = spark.createDataFrame([(1, "p q " + "z " * 38), (2, "p q " + "z " * 39)], "doc_id long, text string")
    t = spark.createDataFrame([("x", "p q")], "item_id string, text string")
    assert {r.doc_id: r.contaminated for r in postings.contamination(d, t).collect()} == {1: True, 2: False}
