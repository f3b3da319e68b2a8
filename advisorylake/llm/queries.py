"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from advisorylake.llm import (
    anchors, contextual_pii, host_rules, importance, lexicon, oracles, piece_scan, postings, prefix_trie, rendezvous, simhash, target_resampling, token_counts, tool_calls)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op2_postings"] = oracles.OP2


@query
def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path(token_counts.TOKENIZER))


#: Argument schemas of the tools that the conversations' turns are read as calls of.
TOOLS = {
    name: {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {
        "text": {"type": "string"}, "limit": {"type": "integer", "minimum": 0, "maximum": 1000}}}
    for name in ("reply", "search", "translate")}


@query
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as calls, the turn after each as its result.

    The table has no calls, so their envelopes are derived from whole turns: the hash of a text picks its tool, whether
    it builds on the assistant turn before, and the arguments that are of a wrong type or missing.
    """
    turns = table(spark, sf_dir, "conversations")
    text, h = F.coalesce("text", F.lit("")), F.crc32(F.coalesce("text", F.lit("")))
    name = lambda shift: F.concat_ws("-", F.lit("c"), "conv_id", (F.col("turn") - shift).cast("string"))
    limit = F.when(h % 7 == 0, F.lit('"many"')).otherwise((F.length(text) % 1000).cast("string"))
    words = F.when(h % 11 != 0, F.concat(F.lit('"text":'), F.expr("substring(to_json(array(coalesce(text, ''))), 2, length(to_json(array(coalesce(text, '')))) - 2)")))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", name(0).alias("call_id"), F.col("turn").alias("seq"), F.element_at(F.array(*map(F.lit, TOOLS)), (h % 3 + 1).cast("int")).alias("name"),
        F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"limit": '), limit), words), F.lit("}")).alias("arguments"),
        F.when(h % 3 != 0, name(2)).alias("after"))
    results = turns.where("role <> 'assistant'").select(name(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("result"))
    return tool_calls.link(calls, results, TOOLS)


@query
def op6_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = anchors.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_anchors"] = oracles.OP6


@query
def op7_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op8_host_rules"] = oracles.OP8


@query
def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = rendezvous.assign(table(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("key"))


@query
def op10_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the hash of the text that decoding them gives back."""
    return corpus_pipeline.tokens(spark, table(spark, sf_dir, "documents"), sf_dir)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.turn_sequences(table(spark, sf_dir, "conversations")))


ORACLES["op11_prefix_trie"] = oracles.OP11


@query
def op12_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contextual_pii.extract(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, contextual_pii.KINDS), F.sha2(contextual_pii.listed(F.col("base")), 256).alias("base_sha256"),
                        contextual_pii.listed(F.concat("base", "added")).alias("spans"))


@query
def op13_position_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_position_crc"] = oracles.OP13


QUERIES["pipeline"] = corpus_pipeline.run
