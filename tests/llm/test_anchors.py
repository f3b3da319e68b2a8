"""Removed words against a scan of all windows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from advisorylake.llm import anchors


def plain(rows):
    """(id, n_words, removed places, kept text) of each row."""
    split = [(i, [w for w in (t or "").translate({c: " " for c in b"\t\n\x0b\x0c\r"}).split(" ") if w]) for i, t in rows]
    first = {}
    for i, w in split:
        for at in range(len(w) - 12):
            if i is not None:
                gram = tuple(w[at:at + 13])
                first[gram] = min(i, first.get(gram, i))
    out = []
    for i, w in split:
        gone = {p for at in range(len(w) - 12) if i is not None and first[tuple(w[at:at + 13])] < i for p in range(at, at + 13)}
        out.append((i, len(w), sorted(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "a.b"]
    passage = [" ".join(rnd.choices(vocab, k=n)) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(60):
        parts = [" ".join(rnd.choices(vocab, k=rnd.randrange(0, 40)))]
        if rnd.random() < 0.7:
            parts.append(rnd.choice(passage))
            parts.append(" ".join(rnd.choices(vocab, k=rnd.randrange(0, 20))))
        rows.append((i * 7 % 61, rnd.choice([" ", "\n", " \t "]).join(parts)))
    same = " ".join(rnd.choices(vocab, k=40))
    rows += [(100 + i, same) for i in range(20)] + [(300, same + " tail"), (301, "tail " + same)]
    rows += [(None, same), (None, passage[4]), (400, None), (401, ""), (402, " \n"), (403, "la " * 30000), (404, "la " * 40)]
    rows += [rows[0], (-5, passage[3])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_windows(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, block int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.end)], r.kept)
                  for r in anchors.cut_repeats(docs, range_bytes=100_000).collect()), key=repr)
    assert got == plain(rows)


def test_empty_table(spark):
    assert anchors.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("values", [[5], [0, 1, 2**63, 2**64 - 1], list(range(0, 4000, 7)), [3, 3 + 2**32], [3, 2 + 2**32]])
def test_message_round_trip(values):
    given = np.array(values, np.uint64)
    assert (anchors._unsteps(anchors._steps(given), len(given)) == given).all()
