"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from advisorylake.llm.texts import alnum_words, blocks, cover, nested, run_starts, true_runs, utf8
from advisorylake.session import Scratch

WINDOW_WORDS = 13
#: Test text whose terms and windows are sent to every task. A larger test set is worked
#: off in as many groups as it takes; each group has an index of its own terms.
TEST_BYTES = 32 << 20
#: Start places that a task checks at once.
_PLACES = 1 << 20


class Windows:
    """Distinct windows of a group of test items, by length; terms are numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        self.terms: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            codes = [self.terms.setdefault(w, len(self.terms)) for w in alnum_words(text)]
            size = min(width, len(codes))
            for at in range(len(codes) - size + 1 if size else 0):
                owners.setdefault(tuple(codes[at:at + size]), set()).add(number.get(name, -1))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(w) for w in owners}):
            chosen = [w for w in owners if len(w) == size]
            named = [sorted(owners[w] - {-1}) for w in chosen]
            ends = np.concatenate([[0], np.cumsum([len(n) for n in named])]).astype(np.int64)
            self.by_length[size] = (np.array(chosen, np.int64).reshape(-1, size), ends,
                                    np.array([i for n in named for i in n], np.int64))

    def rarest_first(self, totals: dict[int, int]) -> list[tuple]:
        """Terms and offsets of each window by rising corpus count.

        A window with a term the corpus lacks can't occur and is left out.
        """
        count = np.array([totals.get(t, 0) for t in range(len(self.terms))], np.int64)
        out = []
        for size, (terms, ends, names) in self.by_length.items():
            rows = np.flatnonzero((count[terms] > 0).all(axis=1))
            offsets = np.argsort(count[terms[rows]], axis=1, kind="stable")
            out.append((size, np.take_along_axis(terms[rows], offsets, axis=1), offsets,
                        ends[rows], ends[rows + 1], names))
        return out


def _index_batches(batches: Iterator[pa.RecordBatch], terms: Broadcast, gap: int,
                   ) -> Iterator[pa.RecordBatch]:
    number, part, seq = terms.value.get, TaskContext.get().partitionId(), 0
    for block in blocks(batches, "text"):
        codes, lengths = [np.zeros(0, np.int32)], []
        for text in utf8(block.column("text")):
            words = alnum_words(text or b"")
            lengths.append(len(words))
            codes.append(np.fromiter(map(number, words, repeat(-1)), np.int32, len(words)))
        code, n = np.concatenate(codes), np.array(lengths, np.int64)
        # Documents are set apart, so that neither a phrase nor its neighbourhood
        # reaches from one into the next.
        place = np.arange(len(code)) + np.repeat(np.arange(len(n)) * gap, n)
        known = np.flatnonzero(code >= 0)
        order = known[np.argsort(code[known], kind="stable")]
        found, counts = np.unique(code[order], return_counts=True)
        one = lambda values, kind: nested(np.array([len(values)]), pa.array(values, kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | seq]), nested(np.array([len(block)]), block.column("id")),
             one(n, pa.int32()), one(found, pa.int32()), one(counts, pa.int32()),
             one(place[order], pa.int32())],
            ["block", "ids", "n_words", "terms", "counts", "positions"])
        seq += 1


def build_index(docs: DataFrame, terms: Broadcast, gap: int) -> DataFrame:
    """Postings of the given terms: one row per block of documents.

    Columns: ``block``; ``ids`` and ``n_words`` of its documents; ``terms`` present with
    their ``counts``; ``positions`` of those terms one after another, each list ascending.
    ``docs`` has id and text. A row holds the postings of about BLOCK_BYTES of text, so any
    document, however common its terms, is indexed in bounded memory without a shuffle.
    """
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        partial(_index_batches, terms=terms, gap=gap),
        f"block bigint, ids array<{kind}>, n_words array<int>, terms array<int>, "
        "counts array<int>, positions array<int>")


def term_totals(index: DataFrame) -> DataFrame:
    """(term, total): occurrences of each indexed term in the whole corpus."""
    lists = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return lists.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("total"))


def _places(keys, first, count, group, slop) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, exact) where all terms of a window stand at, or near, their offsets.

    Starts with the list of the rarest term, moved by its offset, and intersects it with the
    moved lists of the others; the lists are one sorted array of (term, position) keys.
    """
    size, terms, offsets = group[:3]
    live = np.flatnonzero((count[terms] > 0).all(axis=1))
    here = count[terms[live, 0]]
    cuts = np.searchsorted(np.cumsum(here), np.arange(0, here.sum() + 1, _PLACES)[1:])
    for rows, n in zip(np.split(live, cuts), np.split(here, cuts)):
        window = np.repeat(rows, n)
        nth = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = (keys[first[terms[window, 0]] + nth] & 0xFFFFFFFF) - offsets[window, 0]
        if slop:  # the rarest term may be out of place too
            shifts = np.arange(-slop, slop + 1)
            window, start = np.repeat(window, len(shifts)), (start[:, None] + shifts).ravel()
        inside = start >= -slop
        window, start = window[inside], start[inside]
        exact = start >= 0
        for j in range(0 if slop else 1, size):
            expected, term = start + offsets[window, j], terms[window, j] << 32
            low = term | np.maximum(expected - slop, 0)
            at = keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)]
            near = (at >= low) & (at <= (term | expected + slop))
            if slop:
                same = term | np.maximum(expected, 0)
                exact &= keys[np.minimum(np.searchsorted(keys, same), len(keys) - 1)] == same
            window, start, exact = window[near], start[near], exact[near]
        yield window, start, exact


def _pairs(doc, window, group) -> np.ndarray:
    """Distinct (document, item number) pairs of the given occurrences."""
    low, high, names = group[3][window], group[4][window], group[5]
    n = high - low
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item = names[np.repeat(low, n) + nth]
    return np.unique(np.repeat(doc, n).astype(np.int64) << 32 | item)


def _match_batches(batches: Iterator[pa.RecordBatch], plan: Broadcast, slop: int, gap: int,
                   ) -> Iterator[pa.RecordBatch]:
    groups, names, n_terms = plan.value
    names = pa.array(names, pa.string())
    for batch in batches:
        for i in range(len(batch)):
            at = lambda c: batch.column(c)[i].values  # noqa: E731, B023
            n = at("n_words").to_numpy().astype(np.int64)
            terms, counts = at("terms").to_numpy(), at("counts").to_numpy().astype(np.int64)
            first, count = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
            first[terms], count[terms] = run_starts(counts), counts
            keys = np.repeat(terms.astype(np.int64) << 32, counts) | at("positions").to_numpy()
            starts = run_starts(n + gap)
            width = int(n.sum() + gap * len(n)) + 1
            exact_pairs, near_pairs, hits = [], [], [np.zeros((0, 2), np.int64)]
            for group in groups if len(keys) else []:
                for window, start, exact in _places(keys, first, count, group, slop):
                    doc = np.searchsorted(starts, np.maximum(start, 0), side="right") - 1
                    exact_pairs.append(_pairs(doc[exact], window[exact], group))
                    near_pairs.append(_pairs(doc[~exact], window[~exact], group))
                    place = np.unique(start[exact])
                    hits.append(np.stack([place, np.full(len(place), group[0])], axis=1))
            hit = np.concatenate(hits)
            begin, end = true_runs(cover(hit[:, 0], hit[:, 1], width))
            owner = np.searchsorted(starts, begin, side="right") - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(begin - starts[owner], pa.int32()), pa.array(end - starts[owner], pa.int32())],
                ["start", "end"])

            def by_doc(found):
                pair = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
                return nested(np.bincount(pair >> 32, minlength=len(n)), names.take(pa.array(pair & 0xFFFFFFFF)))  # noqa: B023

            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), batch.column("block")[i].as_py())), pa.array(np.arange(len(n))),
                 at("ids"), pa.array(n), nested(np.bincount(owner, minlength=len(n)), spans),
                 by_doc(exact_pairs), by_doc(near_pairs)],
                ["block", "row", "id", "n_words", "spans", "items", "near_items"])


def find_phrases(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", width: int = WINDOW_WORDS,
                 slop: int = 0, test_bytes: int = TEST_BYTES) -> DataFrame:
    """One row per document: where windows of test items occur in it, and whose they are.

    Columns: ``doc_id`` (the given name), n_words, spans (merged word ranges of exact occurrences,
    end exclusive), items (sorted ids, as strings, of items with an exact occurrence) and
    near_items (items of which all words of a window stand within ``slop`` words of
    their places without being an exact occurrence).

    Null and empty texts have no words; an item with fewer words than ``width`` is one window,
    an item without words none. Items with a null id are found but not named. Repeated
    documents give repeated rows, repeated items change nothing, extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "postings")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("text"))
    items = tests.select(F.col(item_id).cast("string").alias("name"),
                         F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_groups = max(1, -(-total // test_bytes))
    if n_groups > 1:  # every group must see the same blocks
        rows = scratch.write(rows, "docs")
    found = [_find_group(rows, items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n_groups)) == g),
                         width, slop, scratch) for g in range(n_groups)]
    out = reduce(DataFrame.unionByName, found)
    if n_groups > 1:
        every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        out = out.groupBy("block", "row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            every("spans"), every("items"), every("near_items")).withColumn("spans", merge_spans("spans"))
    done = scratch.write(out.select(
        F.col("id").alias(doc_id), "n_words", "spans", "items",
        F.array_except("near_items", "items").alias("near_items")), "matches")
    scratch.keep_only(done)
    return done


def _find_group(rows: DataFrame, items: DataFrame, width: int, slop: int, scratch: Scratch) -> DataFrame:
    context, gap = rows.sparkSession.sparkContext, 2 * slop + 1
    # At most test_bytes of text, by the grouping above.
    windows = Windows([(r["name"], r["text"].encode()) for r in items.collect()], width)
    index = scratch.write(build_index(rows, context.broadcast(windows.terms), gap), "index")
    totals = {r["term"]: r["total"] for r in term_totals(index).collect()}  # one row per test term
    plan = context.broadcast((windows.rarest_first(totals), windows.names, len(windows.terms)))
    kind = rows.schema["id"].dataType.simpleString()
    return index.mapInArrow(
        partial(_match_batches, plan=plan, slop=slop, gap=gap),
        f"block bigint, row bigint, id {kind}, n_words bigint, "
        "spans array<struct<start:int,end:int>>, items array<string>, near_items array<string>")


def merge_spans(column: str):
    """Union of sorted half-open ranges, as disjoint ranges."""
    return F.expr(f"""
        aggregate({column}, cast(array() as array<struct<start:int,end:int>>),
          (done, s) -> CASE WHEN size(done) > 0 AND element_at(done, -1).end >= s.start
            THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
                   'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
            ELSE concat(done, array(s)) END)""")


def contamination(docs: DataFrame, tests: DataFrame, **names) -> DataFrame:
    """``find_phrases`` with n_hit (words inside any occurrence), n_items and the verdict:
    contaminated if a twentieth of the words or more are hit."""
    found = find_phrases(docs, tests, **names)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
