"""Ids against the sentencepiece library, whole and in chunks; decoding as a round trip."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from advisorylake.llm import piece_scan as ps

PATH = public_tokenizers.path(ps.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["the ", "ing", "tion", "Étéé", "  ", "    ", "\n", "\n\n", "\t", "中文", "🙂", "ẛ", "ﬁ", "aaaa", "0", "2024", ".", "...", "'s ", "eau",
         "x", "▁", "def f(x):\n    return", "http://", " ", "schaft", "<s>", "<0x0A>", "\x00", "é", "ththth", "====", "的的的"]


def random_text(rnd, n):
    return "".join(rnd.choice(PARTS) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return ps.load(PATH)


@pytest.mark.parametrize("seed", range(4))
def test_lattice_is_the_library(model, seed):
    rnd = random.Random(seed)
    pieces = [LIBRARY.id_to_piece(i) for i in range(300, 32000)]
    texts = [random_text(rnd, rnd.randrange(1, 40)) for _ in range(300)]
    texts += ["".join(rnd.choices(pieces, k=rnd.randrange(1, 8))).replace("▁", " ") for _ in range(1500)]
    texts += ["a" * k for k in range(1, 40)] + [" " * k for k in range(1, 40)] + ["=" * 300, "-=" * 99]
    ids, n = ps.solve(model, [(" " + t).replace(" ", ps.SPACE) for t in texts])
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == LIBRARY.encode(text), text


@pytest.mark.parametrize("size", [16, 17, 40, 200])
def test_chunks_equal_the_whole(model, size):
    rnd = random.Random(size)
    texts = [random_text(rnd, rnd.randrange(20, 120)) for _ in range(25)]
    texts += ["a" * 300, "=" * 200, " " * 150, "lowlowlow" * 40, "的" * 90, "ab" * 100 + "\n"]
    for text in texts:
        marked, margin = (" " + text).replace(" ", ps.SPACE), model.longest
        chunks = []
        for a in range(0, len(marked), size):
            left = min(a, margin)
            chunks.append(ps.Chunk(model, left, min(size, len(marked) - a), marked[a - left:a + size + margin]))
        states = ps.border_states([c.matrix() for c in chunks])
        got = [i for c, (a, b) in zip(chunks, zip(states, states[1:])) for i in c.ids(a, b).tolist()]
        assert got == LIBRARY.encode(text), text
        held = [ps._Memory()]
        assert [i for c, (a, b) in zip(chunks, zip(states, states[1:])) for i in c.ids(a, b, held).tolist()] == got, text


def test_products_are_associative():
    rnd = np.random.default_rng(0)
    a, b, c = (np.where(rnd.random(s) < 0.4, rnd.random(s), -np.inf) for s in ((3, 5), (5, 4), (4, 6)))
    assert np.array_equal(ps.times(ps.times(a, b), c), ps.times(a, ps.times(b, c)))


def test_table_and_round_trip(spark):
    rnd = random.Random(9)
    rows = [(i, random_text(rnd, rnd.randrange(0, 60)), "x") for i in range(80)]
    rows += [(None, "no id", "x"), (3, rows[3][1], "x"), (100, None, "x"), (101, "", "x"), (102, " ", "x"),
             (103, random_text(rnd, 20_000), "x"), (104, "b" * 5000, "x"), (None, "y z " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = ps.encode(docs, PATH, chunk_chars=3000)
    got = sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=repr)
    assert got == sorted(((i, LIBRARY.encode(t or "")) for i, t, _ in rows), key=repr)
    texts = sorted(((r.doc_id, r.text) for r in ps.decode(encoded, PATH).collect()), key=repr)
    assert texts == sorted(((i, (t or "").replace("▁", " ")) for i, t, _ in rows), key=repr)


def test_texts_of_many_chunks(spark, monkeypatch):
    """Chunks of production size, and a tree of several levels."""
    rnd = random.Random(4)
    rows = [(1, random_text(rnd, 90_000)), (2, "a" * 20_000), (3, "x" * ps.CHUNK_CHARS), (4, "the " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ps, "FAN", 3)
    assert all(len(t) >= ps.CHUNK_CHARS for _, t in rows) and len(rows[0][1]) > 9 * ps.CHUNK_CHARS
    for r in ps.encode(docs, PATH).collect():
        assert list(r.ids) == LIBRARY.encode(rows[r.doc_id - 1][1]), r.doc_id


def test_empty_table(spark):
    assert ps.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_forgetting_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} the {i * i}") for i in range(50)], "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in ps.encode(docs, PATH).collect()} == {
        i: LIBRARY.encode(f"word{i} the {i * i}") for i in range(50)}
