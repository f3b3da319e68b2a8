"""SimHash near-duplicates by multi-index hashing: tables on segments, probed with small Hamming balls."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from advisorylake.llm.texts import blocks, lower_ascii, space_words, utf8
from advisorylake.operators.resolve import connected_components
from advisorylake.session import Scratch

SHINGLE_WORDS = 3
SEED = 42
#: Differing bits at which two fingerprints link, and the segments that the index has a table for.
RADIUS, SEGMENTS = 2, 2
#: Fingerprints of one table bucket that a probe is compared with; members of larger ones are linked by all their bits.
BUCKET = 64
#: Shingles counted at once, so that the bits of a long text take bounded memory.
_SLICE = 1 << 16


def shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, in slices; nothing for a text without words."""
    words = space_words(lower_ascii(text or b""))
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    total = len(words) - width + 1
    for a in range(0, total, _SLICE):
        b = min(a + _SLICE, total)
        cuts = map(slice, starts[a:b].tolist(), ends[a + width - 1:b + width - 1].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)),
                          np.uint64, b - a)


def majority(slices: Iterable[np.ndarray]) -> int:
    """The 64 bits that over half of the hashes have; 0 for none. ``slices`` hold them one after another."""
    ones, total = np.zeros(64, np.int64), 0
    for h in slices:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """64 majority bits over the XXH64 of all word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, width))


def set_fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits over the hashes of a set of shingles, each of which counts once."""
    return majority(hashes[a:a + _SLICE] for a in range(0, len(hashes), _SLICE))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        values = np.fromiter((fingerprint(t, width) for t in utf8(block.column("text"))),
                             np.uint64, len(block))
        yield pa.RecordBatch.from_arrays(
            [block.column("id"), pa.array(values.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_fingerprint_batches, width=width), f"id {kind}, fp bigint")


def ball(value: Column, width: int, radius: int) -> Column:
    """Every value that differs from ``value`` in ``radius`` or fewer of its lowest ``width`` bits."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    signed = [F.lit(m - (1 << 64 if m >> 63 else 0)).cast("long") for m in masks]
    return F.transform(F.array(*signed), lambda mask: value.bitwiseXOR(mask))


def segment_keys(fp: Column, segments: int, radius: int) -> Column:
    """Keys of all segments of ``fp``: the number of the segment above each value within ``radius`` bits of its own."""
    if segments < 2:
        raise ValueError("a key has room for a segment of 32 bits, so there are two segments or more")
    keys = []
    for i in range(segments):
        low, high = 64 * i // segments, 64 * (i + 1) // segments
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << high - low) - 1).cast("long"))
        keys.append(ball(value.bitwiseOR(F.lit(i << 32).cast("long")), high - low, radius))
    return F.concat(*keys)


def _split_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all of ``fps`` within ``radius``, where segments tell too few of them apart.

    Two values at distance d have one between them, d // 2 bits from the one and the rest from the other. Every
    fingerprint stands under all values within radius // 2 bits and asks at those one bit further if the radius is odd; all that
    meet link to the smallest that stands there, so there is one link a key and a dense group isn't squared.
    """
    near, far = radius // 2, radius - radius // 2
    met = fps.select(F.col("fp").alias("a"), F.explode(ball(F.col("fp"), 64, far)).alias("between"))
    stands = F.bit_count(F.col("a").bitwiseXOR(F.col("between"))) <= near
    least = F.min(F.when(stands, F.col("a"))).over(W.partitionBy("between"))
    return met.withColumn("b", least).where("b IS NOT NULL").select("a", "b")


def links(distinct_fps: DataFrame, fp: str = "fp", radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET,
          scratch: Scratch | None = None) -> DataFrame:
    """Verified links (a, b), a < b, that connect all fingerprints at ``radius`` differing bits or fewer.

    There is a table for each segment, with a row for every fingerprint under its value there. Of two fingerprints within the
    radius one segment differs by radius // segments bits or fewer, so each probes the tables with the balls of that
    radius around its segments, and the whole distance to everything it meets is verified. A fingerprint that probes a
    bucket of more than ``bucket`` rows (near copies share segments) is taken out of the probes; all of these are linked by
    the bits of all segments together (``_split_links``). The others probe the tables of all, so every pair with one of
    them is found too, and a probe meets ``bucket`` rows at most: links grow with the fingerprints and none is lost.
    ``fp`` holds distinct signed 64-bit values; an empty table has no links.
    """
    scratch = scratch or Scratch(distinct_fps.sparkSession, "simhash-links")
    fps = distinct_fps.select(F.col(fp).alias("fp"))
    table = fps.select(F.col("fp").alias("b"), F.explode(segment_keys(F.col("fp"), segments, 0)).alias("key"))
    probed = lambda some: some.select(F.col("fp").alias("a"), F.explode(
        segment_keys(F.col("fp"), segments, radius // segments)).alias("key"))
    large = scratch.write(table.groupBy("key").count().where(F.col("count") > bucket).select("key"), "large-buckets")
    dense = scratch.write(probed(fps).join(large, "key", "left_semi").select(F.col("a").alias("fp")).distinct(), "dense")
    met = probed(fps.join(dense, "fp", "left_anti")).join(table.join(large, "key", "left_anti"), "key").select("a", "b")
    return (met.union(_split_links(dense, radius)).where(F.col("a") != F.col("b"))
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE_WORDS, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    Rows link at ``radius`` or fewer differing bits; ``component_id`` is the smallest id reachable.
    Null and empty texts have fingerprint zero and link like any other. A null id takes part
    but never names a component; a component without any id has a null component_id.
    Repeated rows give repeated rows. Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    edges = scratch.write(links(distinct, radius=radius, segments=segments, scratch=scratch), "links")
    labels, _ = connected_components(edges)
    member = distinct.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left")
    named = scratch.write(member.select("fp", F.coalesce("component", "fp").alias("component"),
                                        "first_id"), "members")
    roots = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = scratch.write(named.join(roots, "component").select("fp", "component_id"), "classes")
    scratch.keep_only(rows, classes)
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id")
