"""Near copies by exact Jaccard similarity of word shingles, found by SimHash tables and, where fingerprints lie too far apart, a prefix join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.llm import simhash
from advisorylake.llm.simhash import set_fingerprint, shingle_hashes
from advisorylake.llm.texts import blocks, nested, utf8
from advisorylake.operators.resolve import connected_components
from advisorylake.session import Scratch, scratch_path

SHINGLE_WORDS = 5
#: Sets of fewer shingles have no near copy but themselves: 3 of 4 is below 0.8.
LEAST_SHINGLES = 4
#: Shingles that a task counts at once, and common ones that are sent to all. They only decide the order of shingles.
COUNTED, COMMON = 4_000_000, 400_000


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct XXH64 values of the word shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def _digest_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        sets = [shingle_set(t, width) for t in utf8(block.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [block.column("id"), pa.array([len(s) for s in sets], pa.int32()),
             pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
             pa.array(np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64))], ["id", "n", "digest", "fp"])


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        sets = [shingle_set(t, width) for t in utf8(block.column("text"))]
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        yield pa.RecordBatch.from_arrays(
            [block.column("id"), nested(np.array([len(s) for s in sets], np.int64), pa.array(values.view(np.int64)))],
            ["id", "tokens"])


def _repeat_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingles that several different sets of a task share, with their number."""
    held, seen, n = [], set(), 0

    def counted() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        twice = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[twice].view(np.int64)), pa.array(counts[twice])], ["token", "n"])

    for block in blocks(batches, "text"):
        for text in utf8(block.column("text")):
            found = shingle_set(text, width)
            digest = xxhash.xxh3_64_intdigest(found.tobytes())
            if digest in seen:
                continue
            seen.add(digest)
            held.append(found)
            n += len(found)
            if n >= COUNTED:
                yield counted()
                held, seen, n = [], set(), 0
    yield counted()


def _prefix_batches(batches: Iterator[pa.RecordBatch], width: int, common: Broadcast) -> Iterator[pa.RecordBatch]:
    known, counts = common.value
    for block in blocks(batches, "text"):
        tokens, sizes, rests, rows = [np.zeros(0, np.uint64)], [], [], []
        for row, text in enumerate(utf8(block.column("text"))):
            found = shingle_set(text, width)
            n = len(found)
            if n < LEAST_SHINGLES:
                continue
            count = np.zeros(n, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                count = np.where(known[at] == found, counts[at], 0)
            first = n - (4 * n + 4) // 5 + 1
            tokens.append(found[np.argsort(count, kind="stable")[:first]])
            sizes.append(np.full(first, n))
            rests.append(n - np.arange(first))
            rows.append(np.full(first, row))
        whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tokens).view(np.int64)), block.column("id").take(pa.array(whole(rows))),
             pa.array(whole(sizes), pa.int32()), pa.array(whole(rests), pa.int32())], ["token", "id", "n", "rest"])


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def fingerprint_pairs(distinct: DataFrame, radius: int, segments: int, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: ids of ``distinct`` (id, fp) that SimHash tables connect at ``radius`` differing bits or fewer."""
    fps = scratch.write(distinct.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    named = lambda c: fps.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_id"))
    apart = simhash.links(fps, radius=radius, segments=segments, scratch=scratch).join(named("a"), "a").join(named("b"), "b")
    same = distinct.join(fps, "fp").where("id != first")
    return apart.select(*_pair("a_id", "b_id")).union(same.select(*_pair("id", "first"))).distinct()


def _bucketed(texts: DataFrame) -> tuple[DataFrame, str]:
    """The texts as a table dealt by id, from which later joins by id take rows without shuffling a text."""
    spark = texts.sparkSession
    name = "texts_" + scratch_path(spark, "x").rsplit("-", 1)[-1]
    texts.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").saveAsTable(name, format="parquet")
    return spark.table(name), name


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS,
              radius: int = simhash.RADIUS, segments: int = simhash.SEGMENTS) -> DataFrame:
    """(id_col): the smallest id of each group that pairs of Jaccard similarity 0.8 or more connect.

    The similarity is that of the sets of ``width``-word shingles (all words of a shorter text), as 64-bit hashes.
    Equal sets, the empty one of null texts too, become one by a 128-bit digest. The SimHash fingerprints of the sets go through
    the segment tables of ``simhash.links``, and the pairs that these give are verified by exact similarity. Pairs that differ in more than
    ``radius`` bits, as most near 0.8 do, are found by a prefix join between the groups so far: of two different sets of similarity
    0.8 each has one of the other's shingles among its first n - ceil(0.8 n) + 1, in any order that is the same for
    all, so a join on these finds every pair. Common shingles come last: every task names those that several of its sets
    share, which over all tasks finds any shingle of c documents once c * c exceeds twice the number of tasks. First each set is held against
    the least and the greatest set of each of its shingles, and verified links join most of a group; then all
    pairs that share a shingle across groups are, so no pair is left out and a group of copies isn't squared.
    Ids are distinct; rows with a null id are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-copies")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    digests = rows.mapInArrow(partial(_digest_batches, width=width), f"id {kind}, n int, digest binary, fp bigint")
    distinct = scratch.write(digests.groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp")), "distinct")

    # Ids grow with the input, so they are never sent to all; texts are shuffled once, and the plan is the same at every size.
    long = distinct.where(F.col("n") >= LEAST_SHINGLES).select("id", "fp")
    texts, table = _bucketed(rows.join(long.select("id").hint("merge"), "id", "left_semi"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = scratch.write(texts.join(ids, "id", "left_semi").mapInArrow(
            partial(_set_batches, width=width), f"id {kind}, tokens array<bigint>"), f"{name}-sets")
        of = lambda c: sets.select(F.col("id").alias(c), F.col("tokens").alias(f"{c}_tokens"))
        both = F.size(F.array_intersect("a_tokens", "b_tokens"))
        return scratch.write(pairs.join(of("a"), "a").join(of("b"), "b").where(
            9 * both >= 4 * (F.size("a_tokens") + F.size("b_tokens"))).select("a", "b"), name)

    def grouped(edges: DataFrame) -> DataFrame:
        return connected_components(edges)[0].select(F.col("node").alias("id"), "component")

    def placed(members: DataFrame, group: DataFrame) -> DataFrame:
        return members.join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))

    near = verified(scratch.write(fingerprint_pairs(long, radius, segments, scratch), "near-pairs"), "near")

    often = (rows.select("text").mapInArrow(partial(_repeat_batches, width=width), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("count"))
             .orderBy(F.desc("count"), "token").limit(COMMON).toArrow())
    known = often["token"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    common = spark.sparkContext.broadcast((known[order], often["count"].to_numpy()[order]))

    prefixes = scratch.write(texts.mapInArrow(
        partial(_prefix_batches, width=width, common=common), f"token bigint, id {kind}, n int, rest int"), "prefixes")
    several = prefixes.groupBy("token").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y")
    hits = scratch.write(placed(prefixes.join(several.select("token"), "token"), grouped(near)), "hits")
    scratch.keep_only(distinct, near, hits)

    # What the two can have in common at most, if this is the first shingle they share; 9 * common >= 4 * (n + n) is 0.8.
    possible = lambda m, n, r, s: 9 * F.least(r, s) >= 4 * (m + n)
    member = F.struct("id", "n", "rest", "component")
    ends = hits.join(hits.groupBy("token").agg(F.array(F.min(member), F.max(member)).alias("ends")), "token").select(
        "id", "n", "rest", "component", F.explode("ends").alias("o"))
    tried = scratch.write(
        ends.where((F.col("component") != F.col("o.component")) & possible(F.col("n"), F.col("o.n"), F.col("rest"), F.col("o.rest")))
        .select(*_pair("id", "o.id")).distinct(), "tried")
    links = near.union(verified(tried, "links"))
    scratch.keep_only(distinct, hits, tried, links)
    again = scratch.write(placed(hits.drop("component"), grouped(links)), "placed")
    mixed = again.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    open_ = scratch.write(again.join(mixed.select("token"), "token", "left_semi"), "open")
    other = open_.select("token", *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "rest", "component")])
    across = open_.join(other, "token").where(
        (F.col("id") < F.col("o_id")) & (F.col("component") != F.col("o_component"))
        & possible(F.col("n"), F.col("o_n"), F.col("rest"), F.col("o_rest")))
    left = scratch.write(across.select(*_pair("id", "o_id")).distinct().join(tried, ["a", "b"], "left_anti"), "left")
    labels = connected_components(links.union(verified(left, "more")))[0]
    out = scratch.write(distinct.select("id").join(
        labels.where("node != component").select(F.col("node").alias("id")), "id", "left_anti").select(
        F.col("id").alias(id_col)), "survivors")
    scratch.keep_only(out)
    spark.sql(f"DROP TABLE {table}")
    return out
