"""The five stages in a row against plain versions of them."""

from __future__ import annotations

import sentencepiece

import corpus_pipeline
from advisorylake.llm import importance
from tests.llm import test_anchors, test_near_copies, test_postings
from tests.llm.test_piece_scan import PATH


def test_stages_match_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    drawn = {r.doc_id for r in importance.resample(docs, labels).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in drawn)
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert not bad & drawn and len(drawn) > 0.7 * docs.count()

    lone = set(test_near_copies.plain_survivors(rows))
    rows = [(i, t) for i, t in rows if i in lone]
    cut = {i: (n, gone, kept) for i, n, gone, kept in test_anchors.plain(rows)}
    rows = [(i, cut[i][2] if cut[i][1] else t) for i, t in rows if not cut[i][1] or len(cut[i][1]) < cut[i][0]]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(w[k:k + 13]) for _, t in items for w in [test_postings.words_of(t)] for k in range(max(1, len(w) - 12))}
    clean = []
    for i, t in rows:
        w = test_postings.words_of(t)
        hit = {p for k in range(len(w) - 12) if tuple(w[k:k + 13]) in grams for p in range(k, k + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((i, t))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == [(i, library.encode(t)) for i, t in clean]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d " * 20, None, "s", 3), (1, "a b c d " * 20, None, "s", 3), (None, "x", "en", None, 1), (2, None, "en", "s", None),
            (3, "", "en", "s", 0), (4, "w " * 60_000, "en", "s", 9)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "q r s")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 4} and got[2] == 0
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], schema), str(tmp_path))
        assert out.count() == 0 and (name.startswith("Sentence") or out.columns == ["doc_id", "text", "lang", "source", "n_chars"])


def test_leaving_out_contaminated_documents_shuffles_no_text(spark, tmp_path):
    """The few documents that go are sent to all; the many that stay are not."""
    item = " ".join(f"q{i}" for i in range(13))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, item if i == 7 else f"plain text {i}", "en", "s", 9) for i in range(5000)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    try:
        out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == [i for i in range(5000) if i != 7]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange hashpartitioning" not in plan
