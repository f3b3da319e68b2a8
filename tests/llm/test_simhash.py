"""SimHash links and components against all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash

from advisorylake.llm import simhash

VOCAB = [f"w{i}" for i in range(300)] + ["été", "ÇA", "中文"]


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """id of the smallest row reachable, for a list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [least[find(i)] for i in range(len(fps))]


def corpus(seed):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choices(VOCAB, k=rnd.randrange(1, 60))) for _ in range(40)]
    base = " ".join(rnd.choices(VOCAB, k=80))
    near = []
    for _ in range(60):
        words = base.split()
        words[rnd.randrange(80)] = rnd.choice(VOCAB)
        near.append(" ".join(words))
    extra = [None, "", " \t\n", "one", "One", "one two", "a b c", "a  b\x0bc", " x y", "z " * 70_000]
    texts += near + extra + texts[:5]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, texts[4], "x", 1), (None, "lonely text here", None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, bucket int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps))), key=repr)
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


@pytest.mark.parametrize(("radius", "segments", "bucket"), [(2, 2, 64), (2, 2, 1), (2, 3, 4), (3, 2, 2), (3, 4, 64), (4, 4, 8), (1, 2, 1), (0, 2, 1)])
def test_links_connect_all_pairs_within_the_radius(spark, radius, segments, bucket):
    """Small and large buckets, even and odd radii: verified links, and the components of all pairs."""
    rnd = random.Random(radius * 100 + segments * 10 + bucket)
    fps = {0, (1 << 64) - 1} | {rnd.getrandbits(64) for _ in range(40)}
    for base in rnd.sample(sorted(fps), 6):
        near = [base]
        for _ in range(25):
            value = rnd.choice(near)
            for bit in rnd.sample(range(64), rnd.randrange(1, radius + 2)):
                value ^= 1 << bit
            near.append(value)
        fps |= set(near)
    half = rnd.getrandbits(32)  # one segment shared by unrelated values
    fps = sorted(fps | {half << 32 | rnd.getrandbits(32) for _ in range(30)} | {rnd.getrandbits(32) << 32 | half for _ in range(30)})
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r.a, r.b) for r in simhash.links(frame, radius=radius, segments=segments, bucket=bucket).collect()]
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert len(set(found)) == len(found) and all(a < b and apart(a, b) <= radius for a, b in found)

    def components(pairs):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {v: find(v) for v in signed}

    every = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if apart(a, b) <= radius]
    assert components(found) == components(every)
    assert bool(every) == (radius > 0)


def test_one_segment_has_no_room_for_its_number(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), segments=1)


def test_links_stay_linear_in_a_dense_group(spark):
    """All values in a ball of radius two: millions of pairs, one link per value and key."""
    ball = {0} | {1 << i for i in range(62)} | {1 << i | 1 << j for i in range(62) for j in range(i)}
    fps = spark.createDataFrame([(v,) for v in ball], "fp long")
    assert simhash.links(fps).count() <= 65 * len(ball)
