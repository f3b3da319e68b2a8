"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.llm.texts import Codes, blocks, lower_ascii, mix, run_starts, space_words, utf8, word_hashes
from advisorylake.session import Scratch

#: Hash buckets of each order, and orders (words and pairs) of the two models.
BUCKETS = 1 << 14
ORDERS = 2
#: Labelled rows, the first by the hash of their id, that fit the target model and the cut.
LABELLED_ROWS = 20_000
SMOOTHING = 1.0
_TOKENS = re.compile(rb"[a-z0-9_\x80-\xff]+|[^\sa-z0-9_\x80-\xff]+").findall
#: Stands for a token equal to the one before it, so that stutter is one feature.
_AGAIN = np.uint64(1)


def features(texts: Iterator[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram: words, punctuation runs, and pairs of them."""
    codes, coded, n_words = Codes(), [np.zeros(0, np.int32)], []
    for text in texts:
        words = space_words(lower_ascii(text or b""))
        coded.append(codes.encode(words))
        n_words.append(len(words))
    tokens = [_TOKENS(w) for w in codes.words()]
    per_word = np.fromiter(map(len, tokens), np.int64, len(tokens))
    hashes = word_hashes([t for ts in tokens for t in ts])
    word, n_words = np.concatenate(coded), np.array(n_words, np.int64)
    n = per_word[word]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    token = hashes[np.repeat(run_starts(per_word)[word] if len(word) else word, n) + nth]
    doc = np.repeat(np.repeat(np.arange(len(n_words)), n_words), n)
    inner = doc[1:] == doc[:-1]
    again = np.concatenate([[False], inner & (token[1:] == token[:-1])]) if len(token) else np.zeros(0, bool)
    token = np.where(again, _AGAIN, token)
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    single = (mix(token) >> shift).astype(np.int64)
    pair = (mix(token[:-1] * np.uint64(0x9E3779B97F4A7C15) + token[1:])[inner] >> shift).astype(np.int64)
    return np.concatenate([doc, doc[1:][inner]]), np.concatenate([single, pair + BUCKETS])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw = np.zeros(ORDERS * BUCKETS, np.int64)
    target = raw.copy()
    for block in blocks(batches, "text"):
        doc, bucket = features(utf8(block.column("text")))
        raw += np.bincount(bucket, minlength=len(raw))
        chosen = block.column("target").to_numpy(zero_copy_only=False)
        target += np.bincount(bucket[chosen[doc]], minlength=len(raw))
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                                     ["bucket", "raw", "target"])


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows, and of those with ``target`` true.

    Each task returns its sums, at most ORDERS * BUCKETS rows.
    """
    parts = docs.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(
        _count_batches, "bucket bigint, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with add-one smoothing in each order."""
    raw, target = np.zeros((2, ORDERS * BUCKETS))
    for row in counts.collect():  # at most ORDERS * BUCKETS rows
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    share = lambda c: np.log((c + SMOOTHING) / (c.reshape(ORDERS, -1).sum(axis=1, keepdims=True)
                                                + SMOOTHING * BUCKETS).repeat(BUCKETS, axis=1).ravel())
    return share(target) - share(raw)


def _weight_batches(batches: Iterator[pa.RecordBatch], ratios: Broadcast) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        doc, bucket = features(utf8(block.column("text")))
        weight = np.bincount(doc, weights=ratios.value[bucket], minlength=len(block)).astype(np.float64)
        yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(weight)], ["id", "log_weight"])


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a stable key, so that a repeated task draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.ln(-F.ln(u))


def kth_largest(df: DataFrame, column: str, k: int, most: int = 5000) -> float | None:
    """Exact k-th largest value, found by counting ever finer ranges.

    Reads the column a few times; no sort, and never more than ``most`` values on the driver.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while low < high:
        inside = df.where(F.col(column).between(low, high))
        if inside.count() <= most:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]
        place = F.floor((F.col(column) - low) / ((high - low) / 256)).cast("long")
        ranges = inside.groupBy(place.alias("p")).agg(
            F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).orderBy(F.desc("p")).collect()
        for r in ranges:  # 257 rows at most
            if r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            k -= r["n"]
    return low


def cut_between(scored: DataFrame) -> float:
    """Log weight half way between the lowest targets and the highest rejects.

    ``scored`` has log_weight and target of labelled rows. One in 200 on either side is
    left out as noise. Without rejects everything is target-like.
    """
    low = F.percentile(F.when(F.col("target"), F.col("log_weight")), F.lit(0.005))
    high = F.percentile(F.when(~F.col("target"), F.col("log_weight")), F.lit(0.995))
    a, b = scored.agg(low, high).first()
    if b is None:
        return float("-inf")
    return float("inf") if a is None else (a + b) / 2


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, seed: int = 7) -> DataFrame:
    """One row per document: id_col, log_weight, sample_key, kept.

    The weight of a document is the ratio of its probability under the target model (labelled
    rows with label 1, ``labelled_rows`` labelled rows at most) to that under the raw model (all rows), both over hashed
    words and pairs. Adding Gumbel noise to log weights and taking the k largest draws k
    documents without replacement in proportion to their weights. ``k`` defaults to the
    number of documents whose weight lies on the targets' side of the labelled rows.

    A text without words, or null, has log weight 0. Rows of one id share their noise; rows equal to the k-th
    key all stay, so ties never depend on order. Without labels of either kind nothing is rejected. Extra columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (F.max(label_col) == 1).alias("target"))
    scratch = Scratch(spark, "importance")
    sample = scratch.write(known.orderBy(F.xxhash64("id"), "id").limit(labelled_rows), "labelled")
    ratios = log_ratios(ngram_counts(rows.join(F.broadcast(sample), "id", "left")))
    kinds = sample.agg(F.count_if("target"), F.count_if(~F.col("target"))).first()
    if not min(kinds):  # nothing to tell apart
        ratios = np.zeros_like(ratios)
    kind = rows.schema["id"].dataType.simpleString()
    weighed = scratch.write(rows.mapInArrow(
        partial(_weight_batches, ratios=spark.sparkContext.broadcast(ratios)), f"id {kind}, log_weight double").withColumn(
        "sample_key", F.col("log_weight") + gumbel(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)), "weights")
    if k is None:
        cut = cut_between(weighed.join(F.broadcast(sample), "id")) if min(kinds) else float("-inf")
        k = weighed.where(F.col("log_weight") >= cut).count()
    least = kth_largest(weighed, "sample_key", k)
    scratch.keep_only(weighed)
    kept = F.col("sample_key") >= least if least is not None else F.lit(False)
    return weighed.select(F.col("id").alias(id_col), "log_weight", "sample_key", kept.alias("kept"))
