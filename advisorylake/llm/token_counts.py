"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from advisorylake.llm.texts import Codes, blocks, run_starts, space_words, utf8

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
#: Text bytes given to the tokenizer at once, and pieces a worker remembers between blocks.
BATCH_BYTES = 128 << 10
REMEMBERED = 300_000


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def _balanced(pieces: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive pieces of about BATCH_BYTES together."""
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    start = 0
    while start < len(pieces):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BATCH_BYTES, side="right")))
        yield pieces[start:stop]
        start = stop


def _lengths(pieces: list[bytes], path: str) -> np.ndarray:
    """Tokens of each distinct piece; a worker encodes a piece once while it remembers it."""
    tokenizer, known = _tokenizer(path)
    if len(known) + len(pieces) > REMEMBERED:
        known.clear()
    fresh = [p for p in pieces if p not in known]
    for batch in _balanced(fresh):
        encoded = tokenizer.encode_batch_fast([p.decode() for p in batch], add_special_tokens=False)
        known.update(zip(batch, map(len, encoded)))
    return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        codes, coded, n, size = Codes(), [], [], []
        for text in utf8(block.column("text")):
            pieces = space_words(text or b"")
            coded.append(codes.encode(pieces))
            n.append(len(pieces))
            size.append(len(text or b""))
        total = np.concatenate([[0], np.cumsum(_lengths(codes.words(), path)[np.concatenate(coded)])]).astype(np.int64)
        starts, n = run_starts(np.array(n)), np.array(n)
        yield pa.RecordBatch.from_arrays(
            [block.column("id"), pa.array(size, pa.int64()), pa.array(total[starts + n] - total[starts])],
            ["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``path`` is a file of the tokenizers library whose vocabulary drops white space, as
    word-end BPE does: a text may then be cut at any ASCII white space without a change of its
    tokens. Texts, however long, are cut there; the distinct pieces of a block are encoded
    in batches balanced by bytes, and only lengths come back. Null counts as empty, repeated
    rows stay, extra columns are ignored. The tokenizer's special strings count as its default says.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(partial(_count_batches, path=path), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > max_tokens).alias("over_limit"))
