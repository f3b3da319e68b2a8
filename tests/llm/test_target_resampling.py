"""Position-table checksums against zlib, and the draw against plain counts and a sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from advisorylake.llm import oracles, queries, target_resampling as tr
from tests.compare import compare, duck


def test_checksums_of_spans():
    rnd = random.Random(3)
    data = np.frombuffer(rnd.randbytes(300_000), np.uint8)
    sizes = [0, 1, 2, 7, 40, 511, 512, 513, 1023, 1024, 1025, 5 * 512, 5 * 512 + 1, 100_000]
    starts = np.array([rnd.randrange(190_000) for _ in range(700)])
    ends = starts + np.array([rnd.choice(sizes[:-1]) for _ in starts])
    ends[5] = starts[5] + sizes[-1]
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert tr.position_table().crc32(data, starts, ends).tolist() == want
    assert tr.PositionTable(4).crc32(data, starts[:9], ends[:9]).tolist() == want[:9]


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain(docs, items, percent=5, least=20):
    grams = lambda text: [b" ".join(w[i:i + k]) for w in [words_of(text)] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g) % 10_000
    s = Counter(bucket(g) for _, t in docs for g in grams(t))
    t = Counter(bucket(g) for x in items for g in grams(x))
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole_s + 10_000) / ((s[b] + 1) * (whole_t + 10_000))))
    out = []
    for doc, text in docs:
        g = grams(text)
        weight = sum(gain(bucket(x)) for x in g)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(words_of(text)), len(g), weight, score))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {}
    for i, r in enumerate(order[:len(order) * percent // 100]):
        rank.setdefault(r, []).append(i + 1)
    return sorted(((*r, rank[r].pop(0) if rank.get(r) else None) for r in out), key=repr)


def test_matches_plain_counts(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "Bee", "é1", "中文", "x-y", "_", "don't", f"w{rnd.randrange(300)}"])
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(60)))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "!! .."), (None, docs[7][1] + " q" * 20), (9, docs[8][1] + " z" * 30),
             (303, "k" * 3000 + " " + "m" * 600 + " tail" * 25), (304, "v w " * 60_000), (305, docs[3][1]), (305, docs[3][1])]
    items = ["Bee a é1 w7 w8", None, "", "中文 w1 w2 w3"]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, place int")
    tests = spark.createDataFrame([(t, "x") for t in items], "text string, bucket string")
    for percent, least in ((5, 20), (40, 0)):
        got = tr.resample(frame, tests, percent, least).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, got), key=repr) == plain(docs, items, percent, least)
        drawn = sorted(r.rank for r in got if r.rank)
        assert drawn == list(range(1, len(drawn) + 1)) and drawn


def test_query_matches_sql(spark, sf_dir):
    assert compare(queries.op13_position_crc(spark, sf_dir), duck(sf_dir), oracles.OP13) is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tr.resample(empty, empty).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert tr.resample(some, empty).first().n_features == 3
