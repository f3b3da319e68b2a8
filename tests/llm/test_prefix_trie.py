"""The trie against one built turn by turn, over one partition and over many."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from advisorylake.llm import oracles, prefix_trie as pt, queries
from tests.compare import compare, duck

SCHEMA = "conv_id long, turn int, role string, text string, words string, part int"


def rebuilt(rows):
    """Sequences of (role, text) by conversation."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    return out


def plain(sequences):
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    end = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if sequences[c] == p).encode()).hexdigest()
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], end(p))
                  for p in members)


def got(frame):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert frame.columns == columns
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0], r[1]))


def random_rows(seed, n, alphabet, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(longest)):
            rows.append((rnd.choice([c, c * 3]) if seed == 2 else c, t, rnd.choice(["user", "assistant", None]), rnd.choice(alphabet), "x", 1))
    return rows


@pytest.mark.parametrize("seed, n, alphabet, longest", [
    (0, 60, ["a b", "c"], 6), (1, 150, ["a", "b c d", ""], 9), (2, 80, ["x y", None, "x", "z"], 5), (3, 40, ["same words"], 30), (4, 300, [f"t{i} u" for i in range(40)], 4)])
def test_matches_plain_trie(spark, seed, n, alphabet, longest):
    rows = random_rows(seed, n, alphabet, longest)
    rows += [(None, 1, "user", "lost", "x", 1), (1000, None, "user", "first", "x", 1), (1000, 0, None, None, "x", 1), (1000, 0, None, None, "x", 1)]
    sequences = pt.turn_sequences(spark.createDataFrame(rows, SCHEMA))
    want = plain(rebuilt(rows))
    assert got(pt.prefix_trie(sequences)) == want
    assert got(pt.prefix_trie(sequences, part_turns=15)) == want


def test_one_giant_conversation_and_copies(spark):
    rows = [(c, t, "user", f"turn {t}", "x", 1) for c in (40, 41, 60, 61, 80) for t in range(700 if c < 80 else 650)]
    rows += [(c, 0, "user", "hello you", "x", 1) for c in range(100, 400)]
    want = plain(rebuilt(rows))
    assert got(pt.prefix_trie(pt.turn_sequences(spark.createDataFrame(rows, SCHEMA)), part_turns=400)) == want


def test_turnless_and_empty(spark):
    kinds = "conv_id long, turns array<struct<digest: binary, words: bigint>>"
    frame = spark.createDataFrame([(7, []), (3, [])], kinds)
    assert got(pt.prefix_trie(frame)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
    assert pt.prefix_trie(spark.createDataFrame([], kinds)).count() == 0
    assert pt.prefix_trie(pt.turn_sequences(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_matches_sql(spark, sf_dir):
    assert compare(queries.op11_prefix_trie(spark, sf_dir), duck(sf_dir), oracles.OP11) is None
