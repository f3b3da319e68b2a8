"""Importance resampling towards a target distribution, on CRC32 buckets of word n-grams.

CRC32 is linear up to a constant that depends on the length alone: the checksum of a message is the XOR of what each of its bytes
contributes at its distance from the end, XOR the checksum of as many zero bytes. A table of those contributions by
distance and byte turns the checksums of all n-grams of a block of texts into one gather and one
``bitwise_xor.reduceat`` over their spans.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.llm.texts import alnum_words, blocks, utf8
from advisorylake.session import Scratch

BUCKETS = 10_000
ORDERS = 3
#: Distances that the position table covers; longer spans fold in blocks of so many bytes.
DEPTH = 512
#: Bytes of spans gathered at once.
_SLICE = 1 << 16


class PositionTable:
    """Contributions of every byte at every distance from the end of a message."""

    def __init__(self, depth: int = DEPTH) -> None:
        first = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            first = np.where(first & 1, (first >> 1) ^ np.uint32(0xEDB88320), first >> 1).astype(np.uint32)
        at = np.empty((depth, 256), np.uint32)
        at[0] = first
        for d in range(1, depth):  # one more zero byte behind
            at[d] = (at[d - 1] >> 8) ^ first[at[d - 1] & 255]
        self.depth, self.at, self.flat = depth, at, at.ravel()
        self.zeros = np.array([zlib.crc32(bytes(n)) for n in range(depth + 1)], np.uint32)
        #: What each byte of a register becomes behind ``depth`` more bytes: it acts like four bytes before them.
        self.shift = np.stack([at[depth - 1 - j] for j in range(4)])

    @staticmethod
    def moved(shift: np.ndarray, x: np.ndarray) -> np.ndarray:
        return shift[0][x & 255] ^ shift[1][x >> 8 & 255] ^ shift[2][x >> 16 & 255] ^ shift[3][x >> 24]

    def crc32(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unsigned CRC32 of data[start:end] for each span; spans may overlap and be empty."""
        lengths = ends - starts
        out = np.zeros(len(starts), np.uint32)
        short = np.flatnonzero((lengths > 0) & (lengths <= self.depth))
        edges = np.cumsum(lengths[short])
        cuts = np.unique(np.searchsorted(edges, np.arange(0, (edges[-1] if len(edges) else 0) + _SLICE, _SLICE)))
        for a, b in zip(cuts, cuts[1:]):
            some = short[a:b]
            n = lengths[some]
            begins = np.cumsum(n) - n
            low = starts[some].min()  # so that places of a slice fit 32 bits
            place = np.arange(begins[-1] + n[-1], dtype=np.int32)
            place += np.repeat((starts[some] - low - begins).astype(np.int32), n)
            entry = np.repeat((ends[some] - low - 1).astype(np.int32), n)
            entry -= place
            entry <<= 8
            entry |= data[low:][place]
            out[some] = np.bitwise_xor.reduceat(self.flat[entry], begins) ^ self.zeros[n]
        for i in np.flatnonzero(lengths > self.depth).tolist():
            out[i] = self._folded(data[starts[i]:ends[i]]) ^ np.uint32(zlib.crc32(bytes(int(lengths[i]))))
        return out

    def _folded(self, message: np.ndarray) -> np.uint32:
        """Contribution of a long message: blocks by the table, then neighbours fold together; zeros in front change nothing."""
        rows = np.concatenate([np.zeros(-len(message) % self.depth, np.uint8), message]).reshape(-1, self.depth)
        back = np.arange(self.depth - 1, -1, -1) << 8
        state = np.concatenate([np.bitwise_xor.reduce(self.flat[back | some], axis=1) for some in np.array_split(rows, -(-len(rows) // 512))])
        shift = self.shift
        while len(state) > 1:
            if len(state) % 2:
                state = np.concatenate([np.zeros(1, np.uint32), state])
            state = self.moved(shift, state[0::2]) ^ state[1::2]
            shift = np.stack([self.moved(shift, s) for s in shift])
        return state[0]


@cache
def position_table() -> PositionTable:
    return PositionTable()


def features(texts: Iterator[bytes | None], orders: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each order the (text, bucket) of all runs of so many words."""
    joined, n_words = [], []
    for text in texts:
        words = alnum_words(text or b"")
        n_words.append(len(words))
        if words:
            joined.append(b" ".join(words))
    data = np.frombuffer(b" ".join(joined), np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1]) if len(data) else np.zeros(0, np.int64)
    ends = np.concatenate([gaps, [len(data)]]) if len(data) else starts
    n_words = np.array(n_words, np.int64)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    found = []
    for k in range(orders):
        n = max(0, len(doc) - k)
        inside = np.flatnonzero(doc[:n] == doc[k:])
        found.append((doc[inside], (position_table().crc32(data, starts[inside], ends[inside + k]) % np.uint32(buckets)).astype(np.int64)))
    return n_words, found


def _count_batches(batches: Iterator[pa.RecordBatch], orders: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.int64)
    for block in blocks(batches, "text"):
        for _, bucket in features(utf8(block.column("text")), orders, buckets)[1]:
            counts += np.bincount(bucket, minlength=buckets)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``texts`` (text); a task sends at most ``buckets`` rows."""
    parts = texts.mapInArrow(partial(_count_batches, orders=orders, buckets=buckets), "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw text."""
    s, t = np.zeros((2, buckets))
    for counts, into in ((raw, s), (target, t)):
        for row in counts.collect():  # at most one row per bucket
            into[row["bucket"]] = row["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh_batches(batches: Iterator[pa.RecordBatch], orders: int, gain: Broadcast) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        n_words, found = features(utf8(block.column("text")), orders, len(gain.value))
        n, weight = np.zeros((2, len(block)), np.int64)
        for doc, bucket in found:
            n += np.bincount(doc, minlength=len(block))
            # Whole numbers below 2**53 stay exact in the doubles that bincount adds.
            weight += np.bincount(doc, weights=gain.value[bucket], minlength=len(block)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(n_words), pa.array(n), pa.array(weight)],
                                         ["id", "n_words", "n_features", "weight"])


def gumbel_milli(id_text: Column, seed: int) -> Column:
    """1000 times standard Gumbel noise, rounded down, from SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, targets: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id",
             text_col: str = "text", seed: int = 42, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) for every row of ``docs``.

    Words are lower-cased runs of letters, digits and non-ASCII characters; features are all runs of one to ``orders`` words.
    ``weight`` adds the gains of a text's features, ``score`` adds Gumbel noise to it, and of the N rows
    with ``least_words`` words or more the floor(percent * N / 100) highest scores are drawn without replacement; ``rank``
    counts them from 1 and is null for others. Ties go to the smaller id, then the fewer features.

    Null and empty texts have no features and weight 0. Rows of equal id share their noise and stay rows of their own; a null
    id counts as an empty one for the noise and comes after all others on ties. Without targets every gain
    follows from the smoothing alone. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "target-resampling")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = targets.select(F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(rows.select("text"), orders, buckets), bucket_counts(wanted, orders, buckets), buckets)
    kind = rows.schema["id"].dataType.simpleString()
    weighed = rows.mapInArrow(partial(_weigh_batches, orders=orders, gain=spark.sparkContext.broadcast(gain)),
                              f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    noise = gumbel_milli(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + noise), "scored")
    k = scored.where(F.col("n_words") >= least_words).count() * percent // 100

    # One range sort of the narrow rows; places inside a partition and the partitions' sizes give the rank.
    order = [(F.col("n_words") >= least_words).desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.write(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33).cast("int")
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect()):  # one row per partition
        offsets.append((p, before))
        before += n
    first = F.broadcast(spark.createDataFrame(offsets, "part int, before bigint"))
    scratch.keep_only(placed)
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = (F.col("n_words") >= least_words) & (rank <= k)
    return placed.withColumn("part", part).join(first, "part").select(
        F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
