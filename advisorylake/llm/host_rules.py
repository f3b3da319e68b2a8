"""Quality rules whose verdict is passed on whole hosts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from advisorylake.llm.texts import Codes, blocks, cover, space_words, utf8
from advisorylake.session import Scratch

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
#: A host is rejected when the shrunken failure rate of a rule exceeds this.
HOST_RATE = 0.5
#: Bounds of the weight of the prior, in documents.
WEAKEST, STRONGEST = 1.0, 1e6


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur at least twice, first occurrences included."""
    n = len(codes) - 2
    if n < 2:
        return 0
    code = codes.astype(np.int64)
    pair = code[:-1] * distinct + code[1:]
    if distinct > 2_000_000:  # keep the product of three within 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, count = np.unique(pair[:n] * distinct + code[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    return int(cover(starts, 3, len(codes)).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = space_words(text)
    codes = Codes()
    coded = codes.encode(words)
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return (len(words), len(b"".join(words).decode()), sum(text.count(s) for s in SYMBOLS), len(lines),
            len(lines) - len(set(lines)), repeated_words(coded, len(codes.of)))


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    for block in blocks(batches, "text"):
        found = np.array([measures(t or b"") for t in utf8(block.column("text"))], np.int64).reshape(-1, len(names))
        yield pa.RecordBatch.from_arrays(
            [block.column("id"), block.column("host"), *(pa.array(found[:, k]) for k in range(len(names)))],
            ["id", "host", *names])


RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "2 * n_dup_lines > n_lines",
}


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, rule, documents, failures, rate): failure rates shrunk towards all hosts.

    The prior of a rule is a beta distribution fitted to the hosts' rates by moments: its mean is the overall
    rate, its weight m * (1 - m) / v - 1 for the variance v of the rates over hosts, kept within WEAKEST and STRONGEST.
    Hosts combine on the map side, so a host with a third of all rows is one row per task.
    """
    failed = F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(f"CAST({test} AS BIGINT)").alias("failed"))
                       for rule, test in RULES.items()])
    counts = (measured.select("host", F.explode(failed).alias("r")).groupBy("host", "r.rule")
              .agg(F.count("*").alias("documents"), F.sum("r.failed").alias("failures")))
    prior = counts.groupBy("rule").agg(
        (F.sum("failures") / F.sum("documents")).alias("mean"),
        F.var_pop(F.col("failures") / F.col("documents")).alias("spread"))
    weight = F.when(F.col("spread") > 0, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1).otherwise(F.lit(STRONGEST))
    prior = prior.select("rule", "mean", F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), weight)).alias("weight"))
    # One row per rule.
    return counts.join(F.broadcast(prior), "rule").select(
        "host", "rule", "documents", "failures",
        ((F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("documents") + F.col("weight"))).alias("rate"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          host_rate: float = HOST_RATE) -> DataFrame:
    """One row per document: id_col, host_col, the measures, base_failed, host_rejected, kept.

    A document goes if it fails the base rule or if its host is rejected. Null texts have no words, null hosts
    form one host. Repeated rows count each time. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "hosts")
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    measured = scratch.write(rows.mapInArrow(
        _measure_batches, f"id {kind}, host string, n_words bigint, word_chars bigint, n_symbols bigint, "
        "n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"), "measures")
    # Written, so that the join below has a plain shuffle on both sides and skewed hosts are split.
    verdict = scratch.write(host_rates(measured).groupBy("host").agg(
        F.max(F.col("rate") > host_rate).alias("host_rejected")), "verdicts")
    out = measured.join(verdict, measured["host"].eqNullSafe(verdict["host"])).select(
        F.col("id").alias(id_col), measured["host"].alias(host_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        "n_repeat_words", F.expr(RULES["base"]).alias("base_failed"), "host_rejected")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
