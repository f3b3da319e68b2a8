"""Removal of repeated passages with fixed-block anchors.

Three passes over blocks of documents, with two keyed exchanges between them:

1. Every aligned block of ANCHOR words is an index entry, every rolling window of ANCHOR words
   a probe. A repeat of WINDOW = 2 * ANCHOR - 1 words or more holds an aligned block of its
   first document whole, so all probes of entries that occur twice are hits and no repeat is missed.
2. Windows of WINDOW words around hits are compared by their complete hash with the smallest id
   that has them; runs of matching windows are the maximal exact repeats.
3. The words of those runs are cut out.

An exchange sends, for each block of documents and each range of hashes, one row with the sorted
distinct hashes, and gets one bit per hash back. A value that occurs a million times in a
block is one entry, so neither a common passage nor a common line gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from advisorylake.llm.texts import Codes, blocks, cover, nested, rolling, run_starts, space_words, true_runs, utf8, word_hashes
from advisorylake.session import Scratch, scratch_path

ANCHOR = 7
WINDOW = 2 * ANCHOR - 1
#: Text bytes for which one hash range, and one bucket of blocks, is planned.
RANGE_BYTES = 16 << 20
#: The engine allows no more buckets in a table.
MOST_BUCKETS = 100_000


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for block in blocks(batches, "text"):
        codes, lengths, coded = Codes(), [], []
        for text in utf8(block.column("text")):
            words = space_words(text or b"")
            lengths.append(len(words))
            coded.append(codes.encode(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | seq]), nested(np.array([len(block)]), block.column("id")),
             pa.array([np.array(lengths, np.int32).tobytes()], pa.binary()),
             pa.array([b" ".join(codes.words())], pa.binary()),
             pa.array([np.concatenate(coded).tobytes()], pa.binary())],
            ["block", "ids", "lengths", "words", "codes"])
        seq += 1


class Block:
    """A block of documents as numbered words, with the hashes the passes need."""

    def __init__(self, ids: pa.Array, lengths: bytes, words: bytes, codes: bytes) -> None:
        self.ids = ids
        self.lengths = np.frombuffer(lengths, np.int32).astype(np.int64)
        self.words = words.split(b" ") if words else []
        self.codes = np.frombuffer(codes, np.int32)
        self.starts = run_starts(self.lengths)
        self.hashes = word_hashes(self.words)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.offset = np.arange(len(self.codes)) - self.starts[self.doc]
        # A row without an id is neither smaller nor larger than any other.
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def windows(self, width: int) -> np.ndarray:
        """First positions of the windows of ``width`` words inside one document."""
        left = self.lengths[self.doc] - self.offset
        return np.flatnonzero((left >= width) & self.known[self.doc])

    def probe(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Find the distinct anchor hashes of ``bits`` bits: (hashes, has an aligned block,
        stands at several places)."""
        self.anchor_at = self.windows(ANCHOR)
        value, self.anchor_of, count = np.unique(
            rolling(self.hashes, ANCHOR)[self.anchor_at] >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        aligned = np.zeros(len(value), bool)
        aligned[self.anchor_of[self.offset[self.anchor_at] % ANCHOR == 0]] = True
        return value, aligned, count > 1

    def extend(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Find the windows around hits: (distinct complete hashes, smallest id of each)."""
        marked = np.zeros(len(self.codes) + 1, np.int32)
        marked[self.anchor_at[hit[self.anchor_of]] + 1] = 1
        before = np.cumsum(marked)
        start = self.windows(WINDOW)
        self.start = start[before[start + WINDOW - ANCHOR + 1] > before[start]]
        value, self.start_of = np.unique(rolling(self.hashes, WINDOW)[self.start], return_inverse=True)
        self.least = np.full(len(value), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.start_of, self.number[self.doc[self.start]])
        return value, self.least

    def repeated(self, smaller: np.ndarray) -> np.ndarray:
        """Mask of the words of windows that also start in a document with a smaller id."""
        gone = smaller[self.start_of] | (self.number[self.doc[self.start]] > self.least[self.start_of])
        return cover(self.start[gone], WINDOW, len(self.codes))


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for i in range(len(batch)):
        yield i, Block(batch.column("ids")[i].values, *(batch.column(c)[i].as_py() for c in ("lengths", "words", "codes")))


def _answer(rows: list | None, size: int) -> np.ndarray:
    """Bits of the answers of all ranges, one after another as the hashes are sorted."""
    out = np.zeros(size, bool)
    for row in rows or []:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=row["n"])
        out[row["first"]:row["first"] + row["n"]] = bits
    return out


def _steps(values: np.ndarray) -> bytes:
    """Sorted distinct hashes as a first value and differences, of four bytes if all fit."""
    steps = np.diff(values)
    small = not len(steps) or steps.max() < 1 << 32
    return values[:1].tobytes() + steps.astype(np.uint32 if small else np.uint64).tobytes()


def _unsteps(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint32 if len(data) == 4 + 4 * n else np.uint64, offset=8)
    out = np.empty(n, np.uint64)
    out[0] = np.frombuffer(data, np.uint64, 1)[0]
    out[1:] = out[0] + np.cumsum(steps, dtype=np.uint64)
    return out


def _messages(block: int, values: np.ndarray, extra, bits: int, ranges: int) -> pa.RecordBatch | None:
    """One row per hash range that has values; ``first`` is where they begin in the block."""
    edges = [(r << bits) // ranges for r in range(1, ranges)]
    first = np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64))])
    n = np.diff(np.concatenate([first, [len(values)]]))
    used = np.flatnonzero(n)
    cuts = [slice(first[r], first[r] + n[r]) for r in used]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int64()), pa.array(np.full(len(used), block)), pa.array(first[used], pa.int64()),
         pa.array(n[used], pa.int64()), pa.array([_steps(values[c]) for c in cuts], pa.binary()),
         pa.array([extra(c) for c in cuts], pa.binary())],
        ["range", "block", "first", "n", "hashes", "extra"])


MESSAGE = "range bigint, block bigint, first bigint, n bigint, hashes binary, extra binary"
ANSWER = "block bigint, first bigint, n bigint, bits binary"


def _probe_batches(batches: Iterator[pa.RecordBatch], bits: int, ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, block in _blocks_of(batch):
            values, aligned, several = block.probe(bits)
            yield _messages(batch.column("block")[i].as_py(), values, lambda c: np.packbits(  # noqa: B023
                np.concatenate([aligned[c], several[c]])).tobytes(), bits, ranges)  # noqa: B023


def _candidate_batches(batches: Iterator[pa.RecordBatch], bits: int, ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, block in _blocks_of(batch):
            hit = _answer(batch.column("hits")[i].as_py(), len(block.probe(bits)[0]))
            values, least = block.extend(hit)
            yield _messages(batch.column("block")[i].as_py(), values,
                            lambda c: least[c].tobytes(), 64, ranges)  # noqa: B023


def _reply(table: pa.Table, entries: list, decide) -> pa.Table:
    """Decide each entry of a hash range from all blocks' entries with the same hash."""
    n = table.column("n").to_pylist()
    values = np.concatenate([_unsteps(h, k) for h, k in zip(table.column("hashes").to_pylist(), n)])
    order = np.argsort(values, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0]))
    times = np.diff(np.concatenate([new, [len(order)]]))
    verdict = np.empty(len(values), bool)
    verdict[order] = decide(np.concatenate(entries)[order], new, times)
    bits = [np.packbits(v).tobytes() for v in np.split(verdict, np.cumsum(n)[:-1])]
    return pa.table({"block": table.column("block"), "first": table.column("first"), "n": table.column("n"),
                     "bits": pa.array(bits, pa.binary())})


def _is_hit(table: pa.Table) -> pa.Table:
    """A hash is a hit if an aligned block has it and it stands at two places or more."""
    def decide(flags, new, times):
        seen = np.bitwise_or.reduceat(flags, new)
        return np.repeat((seen & 1 > 0) & ((seen & 2 > 0) | (times > 1)), times)

    flags = []
    for data, n in zip(table.column("extra").to_pylist(), table.column("n").to_pylist()):
        both = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * n)
        flags.append(both[:n] | both[n:] << 1)
    return _reply(table, flags, decide)


def _has_smaller(table: pa.Table) -> pa.Table:
    """Whether another block has the window in a document with a smaller id."""
    def decide(least, new, times):
        return np.repeat(np.minimum.reduceat(least, new), times) < least

    return _reply(table, [np.frombuffer(x, np.int64) for x in table.column("extra").to_pylist()], decide)


def _cut_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, block in _blocks_of(batch):
            hit = _answer(batch.column("hits")[i].as_py(), len(block.probe(bits)[0]))
            gone = block.repeated(_answer(batch.column("smaller")[i].as_py(), len(block.extend(hit)[0])))
            # Runs end at document borders.
            begin, end = true_runs(np.insert(gone, block.starts, False))
            docs = np.searchsorted(block.starts + np.arange(len(block.starts)), begin, side="right") - 1
            shift = block.starts[docs] + docs + 1
            spans = pa.StructArray.from_arrays(
                [pa.array(begin - shift, pa.int32()), pa.array(end - shift, pa.int32())], ["start", "end"])
            kept = []
            for start, n in zip(block.starts.tolist(), block.lengths.tolist()):
                codes = block.codes[start:start + n][~gone[start:start + n]]
                kept.append(b" ".join(map(block.words.__getitem__, codes.tolist())))
            removed = np.bincount(block.doc[gone], minlength=len(block.ids))
            yield pa.RecordBatch.from_arrays(
                [block.ids, pa.array(block.lengths), pa.array(removed, pa.int64()),
                 nested(np.bincount(docs, minlength=len(block.ids)), spans), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "spans", "kept"])


def _exchange(messages: DataFrame, decide, name: str) -> DataFrame:
    """(block, name): the answers to each block's messages."""
    said = messages.groupBy("range").applyInArrow(decide, ANSWER)
    return said.groupBy("block").agg(F.collect_list(F.struct("first", "n", "bits")).alias(name))


def _bucketed(blocks_df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """The blocks as a bucketed table, which the later joins read without a shuffle."""
    spark = blocks_df.sparkSession
    name = "blocks_" + scratch_path(spark, "x").rsplit("-", 1)[-1]
    blocks_df.write.bucketBy(buckets, "block").saveAsTable(name, format="parquet")
    return spark.table(name), name


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, spans (removed word ranges, end
    exclusive) and kept (the other words, joined by one space).

    A word goes if it lies in a window of WINDOW words that also starts in a document with a
    smaller id; windows are those of the input. Ids are whole numbers. Null and empty texts have no words. A null
    id is neither smaller nor larger than another, so such rows lose nothing and
    cost others nothing; repeated rows of one id do not remove each other. Extra columns are ignored.

    Windows are compared by 64-bit hashes in the last exchange: among n candidate windows a
    false match has probability n * n / 2**65, about 1e-4 for the windows of 0.5 GB.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Anchors are compared by enough bits to leave few chance hits; the second exchange,
    # with complete hashes, does not depend on them.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    bits = min(64, int(size).bit_length() + 16)
    scratch = Scratch(spark, "anchors")
    stored, name = _bucketed(rows.mapInArrow(
        _block_batches, "block bigint, ids array<bigint>, lengths binary, words binary, codes binary"), min(ranges, MOST_BUCKETS))
    asked = stored.mapInArrow(partial(_probe_batches, bits=bits, ranges=ranges), MESSAGE)
    hits = scratch.write(_exchange(asked, _is_hit, "hits"), "hits")
    marked = stored.join(hits.hint("shuffle_hash"), "block", "left")
    asked = marked.mapInArrow(partial(_candidate_batches, bits=bits, ranges=ranges), MESSAGE)
    smaller = scratch.write(_exchange(asked, _has_smaller, "smaller"), "smaller")
    cut = marked.join(smaller.hint("shuffle_hash"), "block", "left").mapInArrow(
        partial(_cut_batches, bits=bits),
        "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string")
    done = scratch.write(cut, "cut")
    scratch.keep_only(done)
    spark.sql(f"DROP TABLE {name}")
    return done.withColumnRenamed("id", id_col)
