"""Weights against a plain count of n-grams, selection against a sort, labels held out."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from advisorylake.llm import importance as im


def corpus(n=300):
    rnd = random.Random(3)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(n):
        junk = i % 4 == 0
        words = rnd.choices(good, k=60) if not junk else rnd.choices(bad, k=20) + ["***"] * 20 + rnd.choices(good, k=20)
        rows.append((i, " ".join(words), "x", 0.5))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if junk else 1, 0))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, "doc_id long, text string, target string, log_weight double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs, lab = frames(spark, rows, labels)
    got = {r.doc_id: r.kept for r in im.resample(docs, lab, labelled_rows=100).collect()}
    wrong = [i for i in got if got[i] == (i % 4 == 0)]
    assert len(got) == len(rows) and not wrong


def test_weights_match_plain_counts(spark):
    rows, labels = corpus(40)
    docs, lab = frames(spark, rows, labels)
    got = {r.doc_id: r.log_weight for r in im.resample(docs, lab).collect()}
    raw, target = np.zeros((2, 2 * im.BUCKETS))
    chosen = {i for i, q, _ in labels if q == 1}
    feats = {i: im.features([t.encode()])[1] for i, t, *_ in rows}
    for i, f in feats.items():
        np.add.at(raw, f, 1)
        if i in chosen:
            np.add.at(target, f, 1)
    for i, f in feats.items():
        want = 0.0
        for b in f:
            part = slice(0, im.BUCKETS) if b < im.BUCKETS else slice(im.BUCKETS, None)
            want += np.log((target[b] + 1) / (target[part].sum() + im.BUCKETS)) - np.log((raw[b] + 1) / (raw[part].sum() + im.BUCKETS))
        assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("k", [1, 7, 299, 300, 1000])
def test_exactly_the_k_largest_keys(spark, k):
    rows, labels = corpus()
    docs, lab = frames(spark, rows, labels)
    out = im.resample(docs, lab, k=k).collect()
    order = sorted((r.sample_key for r in out), reverse=True)
    assert {r.doc_id for r in out if r.kept} == {r.doc_id for r in out if r.sample_key >= order[min(k, 300) - 1]}
    assert sum(r.kept for r in out) == min(k, 300)


@pytest.mark.parametrize("most", [1, 10])
def test_kth_largest_with_ties(spark, most):
    values = [0.0] * 500 + [1.5] * 30 + [float(i) for i in range(200)] + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 150, 231, 700, 732):
        assert im.kth_largest(df, "v", k, most) == sorted(values, reverse=True)[k - 1]


def test_edge_rows_and_empty_tables(spark):
    rows, labels = corpus(40)
    odd = [(1000, None, None, None), (1001, "", "x", 0.0), (None, rows[1][1], "x", 0.0), rows[2], (1002, "g1 " * 50_000, "x", 0.0)]
    docs, lab = frames(spark, rows + odd, labels + [(None, 1, 0), (5, None, 0), (1, 1, 0)])
    out = im.resample(docs, lab)
    assert out.count() == len(rows) + len(odd)
    assert {r.log_weight for r in out.where("doc_id IN (1000, 1001)").collect()} == {0.0}
    assert im.resample(docs.limit(0), lab).count() == 0
    assert im.resample(docs, lab.limit(0)).where("kept").count() == len(rows) + len(odd)


def test_noise_is_gumbel(spark):
    x = np.array([r.g for r in spark.range(4000).select(im.gumbel(F.col("id").cast("string"), 1).alias("g")).collect()])
    assert abs(x.mean() - 0.5772) < 0.08 and abs(x.var() - np.pi**2 / 6) < 0.2
