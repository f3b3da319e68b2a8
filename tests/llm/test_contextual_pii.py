"""Base spans against the plain patterns, and the bootstrap against a plain graph."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

from advisorylake.llm import contextual_pii as cp, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def valid(kind, found, strict=True):
    d = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 13 <= len(d) <= 19 and (not strict or luhn(d))
    if kind == "phone":
        return 9 <= len(d) <= 15
    return kind == "email" or not strict or all(int(x) <= 255 for x in found.split("."))


def base_of(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII) if valid(k, m.group())]


def plain(docs, rounds=3):
    """(base, added) of each text."""
    words = lambda t: [w for w in re.split(r"\s+", re.sub(r"[\"'`(){}<>\[\]]", " ", re.sub("[0-9]", "0", t.lower())), flags=re.ASCII) if w]
    spans = []
    for row, text in enumerate(docs):
        text = text or ""
        strict = base_of(text)
        found = [(k, True, [m.span() for m in re.finditer(p, text, re.ASCII)]) for k, p in PLAIN.items()]
        found += [(k, False, [m.span() for m in re.finditer(p, text, re.ASCII)]) for k, p in cp.LOOSE.items()]
        for kind, is_strict, places in found:
            cuts = [0, *[e for _, e in places]], [*[s for s, _ in places], len(text)]
            pieces = [text[a:b] for a, b in zip(*cuts)]
            for i, (s, e) in enumerate(places):
                if not valid(kind, text[s:e], is_strict):
                    continue
                if not is_strict and any(s < e2 and s2 < e for _, s2, e2 in strict):
                    continue
                left, right = words(pieces[i][-cp.CONTEXT:]), words(pieces[i + 1][:cp.CONTEXT])
                one, two, after = (left or ["^"])[-1], (["^", "^", *left])[-2], (right or ["^"])[0]
                spans.append((row, is_strict, kind, s, e, text[s:e].lower(), [f"1 {one}", f"2 {two} {one}", f"3 {one} _ {after}"]))
    members, known = defaultdict(set), set()
    for _, is_strict, kind, _, _, value, patterns in spans:
        for p in patterns:
            members[p].add((kind, value))
        if is_strict:
            known.update((p, kind, value) for p in patterns)
    taken = set()
    for _ in range(rounds):
        score = defaultdict(int)
        for p, values in members.items():
            for kind in cp.KINDS:
                k = sum(kd == kind and ((p, kd, v) in known or (kd, v) in taken) for kd, v in values)
                share = k / (len(values) + 1)
                if k >= 2 and share >= 0.5:
                    for kd, v in values:
                        if kd == kind and (p, kd, v) not in known:
                            score[kd, v] += math.floor(-math.log(1 - share) * 1_000_000)
        taken = {x for x, s in score.items() if 1 - math.exp(-s / 1_000_000) >= 0.8}
    out = [(base_of(t), []) for t in docs]
    reach = {}
    for row, is_strict, kind, s, e, value, _ in sorted(spans, key=lambda x: (x[0], x[3], cp.KINDS.index(x[2]))):
        if not is_strict and (kind, value) in taken:
            if s >= reach.get(row, 0):
                out[row][1].append((kind, s, e))
            reach[row] = max(reach.get(row, 0), e)
    return [(b, sorted(a, key=lambda x: (cp.KINDS.index(x[0]), x[1]))) for b, a in out]


def luhn_number(rnd):
    d = "".join(rnd.choice("123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def mistyped(rnd, first):
    return next(n for n in iter(lambda: f"{first}{rnd.randrange(10**14, 10**15 - 1)}", "") if not luhn(n))


def corpus():
    rnd = random.Random(5)
    filler = lambda: " ".join(rnd.choice("alpha beta gamma delta house tree of the and über 中文 x1 2024 12-30".split()) for _ in range(rnd.randrange(1, 9)))
    docs = []
    for i in range(60):
        card, mail, phone = luhn_number(rnd), f"user{i}@mail{i % 7}.example.com", f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        docs.append(f"{filler()} card number {card} expires {filler()} write to {mail} today {filler()} call me at {phone} please {filler()} host {i}.{i}.1.{i} up")
    docs += [f"{filler()} card number {mistyped(rnd, 4)} expires {filler()}" for _ in range(9)]
    docs += [f"{filler()} write to jane{i} (at) home{i} (dot) example (dot) org today {filler()}" for i in range(6)]
    docs += [f"{filler()} call me at (415) 555-{1000 + i} please {filler()}" for i in range(6)]
    docs += [f"{filler()} order {mistyped(rnd, 5)} shipped {filler()} the 987-654-{1000 + i} {filler()}" for i in range(9)]
    docs += [None, "", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "a@b.c%x@d.e f@g.h.i@j.k @x.y a@b a@-.-", "4111 1111 1111 1111 4111-1111-1111-1112", "+1" + " " * 50 + "2345678901 +12",
             "é4111111111111111é a.b+c@ö.com mail: x@y.zz.", "7 77 7-7 7- 8--8 12345678901234567890", docs[0], docs[0], docs[70]]
    return docs


def test_matches_plain_graph(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i if i % 7 else None, i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, n long, text string, base string, row int")
    got = {r.n: ([tuple(s) for s in r.base], [tuple(s) for s in r.added]) for r in cp.extract(frame, "n").collect()}
    want = plain(docs)
    for i, text in enumerate(docs):
        assert got[i] == want[i], text
    added = [k for _, a in want for k, _, _ in a]
    assert added.count("card") >= 9 and added.count("email") >= 6 and added.count("phone") >= 6
    assert not any(a for i, (_, a) in enumerate(want) if 81 <= i < 90)  # order numbers stay


def test_long_texts_take_linear_time(spark):
    shapes = ["a", "a.", "1", "1.2.", "a@b.", "9 ", "1 2-", "+", "(1", "a@"]
    small = [x * 300 for x in shapes] + ["+1" + "." * 900]
    large = [x * 30_000 for x in shapes] + ["+1" + "." * 200_000]
    frame = spark.createDataFrame(list(enumerate(small + large)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in cp.extract(frame).collect()}
    assert [got[i] for i in range(len(small))] == [base_of(t) for t in small]
    assert [bool(got[i + len(small)]) for i in range(len(large))] == [bool(base_of(t)) for t in small]


def test_query_columns(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op12_contextual_pii(spark, sf_dir).collect()}
    want = dict(zip([d for d, _ in docs], plain([t for _, t in docs])))
    assert len(got) == len(docs)
    show = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (cp.KINDS.index(x[0]), x[1])))
    for doc, (base, added) in want.items():
        r = got[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in cp.KINDS]
        assert r.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest() and r.spans == show(base + added)


def test_empty_table(spark):
    assert cp.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0
