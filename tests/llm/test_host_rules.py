"""Measures against plain counts, host rates against the formulas, and the SQL twins."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from advisorylake.llm import host_rules as hr, queries
from tests.compare import compare, duck

BLANK = "[ \t\n\x0b\x0c\r]+"


def plain(text):
    words = [w for w in re.split(BLANK, text) if w]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.sub(BLANK, "", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


@pytest.mark.parametrize("seed", range(5))
def test_measures(seed):
    rnd = random.Random(seed)
    for _ in range(80):
        text = "".join(rnd.choice(["a", "b", "é", "中"]) + rnd.choice([" ", " ", "  ", "\n", "|", "\t\n", "\x0b", "# "])
                       for _ in range(rnd.randrange(0, 50)))
        assert hr.measures(text.encode()) == plain(text)


def test_many_distinct_words_do_not_overflow():
    codes = np.array([1, 2, 3, 9, 1, 2, 3], np.int32)
    assert hr.repeated_words(codes, 10) == hr.repeated_words(codes, 3_000_000) == 6


def test_bad_hosts_and_odd_rows(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "x"
    rows = [(i, good, "fine") for i in range(300)] + [(1000 + i, bad if i else good, "rotten") for i in range(200)]
    rows += [(2000, good, "new"), (2001, bad, "new2"), (2002, None, None), (2003, "", None), (None, good, None), (0, good, "fine")]
    rows += [(3000, "t " * 60_000, "fine")]
    docs = spark.createDataFrame([(*r, 5, "y") for r in rows], "doc_id long, text string, source string, n_words int, host string")
    out = {r.doc_id: r for r in hr.judge(docs).collect()}
    assert hr.judge(docs).count() == len(rows)
    assert out[0].kept and out[2000].kept and not out[1000].kept and not out[1000].base_failed and out[1000].host_rejected
    assert not out[2001].kept and out[2002].n_words == 0 and out[2002].base_failed and not out[3000].kept
    assert hr.judge(docs.limit(0)).count() == 0


def test_rates_follow_the_prior(spark):
    rows = [(h, 60, 600, 0, 1, 0, 60 if i < f else 0) for h, n, f in (("a", 50, 5), ("b", 40, 20), ("c", 2, 2)) for i in range(n)]
    frame = spark.createDataFrame(rows, "host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    got = {r.host: r.rate for r in hr.host_rates(frame).where("rule = 'base'").collect()}
    rates, m = np.array([0.1, 0.5, 1.0]), 27 / 92
    weight = min(max(m * (1 - m) / rates.var() - 1, 1), 1e6)
    assert got == pytest.approx({h: (f + m * weight) / (n + weight) for h, n, f in (("a", 50, 5), ("b", 40, 20), ("c", 2, 2))})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLES[name]) is None
