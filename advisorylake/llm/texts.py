"""Words and blocks of texts inside Arrow functions."""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes handled at once by one task; a longer single text is a block of its own.
BLOCK_BYTES = 2 << 20

#: bytes.translate tables: A-Z lowered, and (for ``alnum_words``) every other ASCII byte
#: that is no digit or letter turned into a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALNUM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in _LOWER)


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def space_words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(_ALNUM).split()


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as bytes, without decoding them."""
    if not len(column):
        return
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32, len(column) + 1 + column.offset)[column.offset:].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield None if valid and not valid[i] else bytes(view[at[i]:at[i + 1]])


def give_back() -> None:
    """Return freed memory to the system; a reused worker would keep the peak of every step it ran."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str,
           size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches whose texts take about ``size`` bytes together."""
    try:
        yield from _slices(batches, text, size)
    finally:
        give_back()


def _slices(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column(text)
        if pa.types.is_large_string(lengths.type):
            lengths = lengths.cast(pa.string())
        ends = np.cumsum(np.diff(np.frombuffer(
            lengths.buffers()[1], np.int32, len(lengths) + 1 + lengths.offset)[lengths.offset:]
            )) if len(lengths) else np.zeros(0, np.int64)
        start = 0
        while start < len(batch):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


class Codes:
    """Consecutive numbers for distinct words, and a 64-bit hash of each word."""

    def __init__(self) -> None:
        self.of: dict[bytes, int] = defaultdict(count().__next__)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.int32, len(words))

    def words(self) -> list[bytes]:
        return list(self.of)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.words())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k:k + n]
    return mix(out)


def run_starts(lengths: np.ndarray) -> np.ndarray:
    """First position of each document when ``lengths`` follow one another."""
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(starts: np.ndarray, widths: np.ndarray | int, size: int) -> np.ndarray:
    """Mask of the positions inside any of the given intervals."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + widths, -1)
    return np.cumsum(change[:-1]) > 0


def nested(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column from the number of values of each row."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)
