"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A segmentation is the model's own (pair merges by score, leftmost first on equal scores) exactly if each two neighbouring
pieces are stable: encoding them together gives the two again. So the best path through the lattice of pieces, with
weight 0 for a stable pair and minus infinity for any other, is the model's encoding. Weights of paths add
and alternatives are maximised, which makes the encoding of a chunk a max-plus matrix from the states at
its left border to those at its right border; a state is the piece that reaches or crosses the border.

* Texts of up to CHUNK_CHARS characters are one chunk with one state on either side. Where no piece has the two
  characters around a place, a cut is certain: the lattice falls apart into short runs, and equal words are solved once.
* Longer texts are dealt out as chunks. Each yields its matrix; the matrices of a text, products of
  which are associative, are combined as a tree; going down it again gives the state at every border,
  and then each chunk is traced back on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, partial, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from advisorylake.llm.texts import Codes, blocks, nested, run_starts, utf8
from advisorylake.session import Scratch

MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 1 << 14
#: Neighbouring matrices multiplied by one task at a level of the tree, and levels: enough for the longest text Spark holds.
FAN, LEVELS = 64, 3
#: Characters of new words solved together, and words a worker remembers between blocks.
BATCH_CHARS = 200_000
REMEMBERED = 400_000
#: Chunks whose words are looked up together.
TRACED = 32
#: Rows decoded at once.
DECODED_ROWS = 500
SPACE = "▁"
_NEVER = np.int64(1) << 40
_WORDS = re.compile(rb" +[^ ]*").findall


class Model:
    """Pieces of a BPE model with byte fallback, as arrays that fit one broadcast.

    ``rank`` is the place of a piece's merge by score, -1 for single characters; ``left`` and
    ``right`` are the pieces of the last merge that builds it; ``pair_key`` and ``pair_rank`` hold the rank
    of every two pieces that can merge.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        ordinary = [i for i in range(n) if not (sp.IsUnknown(i) or sp.IsControl(i) or sp.IsByte(i) or sp.IsUnused(i))]
        text = {i: sp.id_to_piece(i) for i in ordinary}
        score = {p: sp.get_score(i) for i, p in text.items()}
        number = {p: i for i, p in text.items()}
        order = {s: r for r, s in enumerate(sorted({-score[p] for p in score if len(p) > 1}))}
        ranks = {p: order[-score[p]] for p in score if len(p) > 1}
        if any(c not in number for p in number for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.size, self.longest = n, max(map(len, number))
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        pairs = {}
        built = []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = rank
            parts = _merge(list(piece), ranks)
            if parts is not None:  # others are never reached by merging
                i = number[piece]
                self.rank[i], self.left[i], self.right[i] = rank, number[parts[0]], number[parts[1]]
                built.append(piece)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        built += [p for p in number if len(p) == 1]
        chars = sorted({c for p in built for c in p})
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        char = {c: k for k, c in enumerate(chars)}
        states, steps, self.piece_at = {"": 0}, {}, [-1]
        for piece in built:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(self.piece_at)
                    steps[states[piece[:k - 1]] * len(chars) + char[piece[k - 1]]] = len(self.piece_at)
                    self.piece_at.append(-1)
            self.piece_at[states[piece]] = number[piece]
        self.piece_at = np.array(self.piece_at, np.int32)
        self.step_key = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_key.tolist()], np.int64)
        joined = {char[p[k]] * len(chars) + char[p[k + 1]] for p in built for k in range(len(p) - 1)}
        self.joined = np.array(sorted(joined), np.int64)
        # A word can be solved apart from its neighbours if no piece has a space after another character.
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in built)
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.out = [text.get(i, "").replace(SPACE, " ").encode() for i in range(n)]
        for b in range(256):
            self.out[self.byte[b]] = bytes([b])

    def stable(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between each two neighbouring pieces.

        Undoes the merges at the border, latest first. The pieces merge across it if at some time both stand there and
        their pair comes before the merges that take either away (on equal scores the left merge comes first).
        """
        ok = np.ones(len(x), bool)
        x, y = x.astype(np.int64), y.astype(np.int64)
        x_until, y_until = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        at = np.arange(len(x))
        while len(at):
            key = x * self.size + y
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            cross = np.where(self.pair_key[k] == key, self.pair_rank[k], _NEVER)
            merged = (cross < x_until) & (cross <= y_until)
            ok[at[merged]] = False
            x_rank, y_rank = self.rank[x], self.rank[y]
            go = ~merged & ((x_rank >= 0) | (y_rank >= 0))
            at, x, y, x_until, y_until, x_rank, y_rank = (a[go] for a in (at, x, y, x_until, y_until, x_rank, y_rank))
            undo_x = x_rank > y_rank
            x_until, y_until = np.where(undo_x, x_rank, x_until), np.where(undo_x, y_until, y_rank)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def char_numbers(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points, and their numbers among the characters of pieces (-1 for others)."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        k = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return points, np.where(self.chars[k] == points, k, -1)

    def certain_cuts(self, chars: np.ndarray) -> np.ndarray:
        """For each character, whether no piece joins it to the one before."""
        key = chars[:-1].astype(np.int64) * len(self.chars) + chars[1:]
        k = np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)
        apart = (self.joined[k] != key) | (chars[:-1] < 0) | (chars[1:] < 0)
        return np.concatenate([[True], apart]) if len(chars) else np.zeros(0, bool)


def _merge(parts: list[str], ranks: dict[str, int]) -> list[str] | None:
    """The two parts of the last merge of a piece, or None if merging does not build it."""
    while len(parts) > 1:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return None
        _, k = min(found)
        if len(parts) == 2:
            return parts
        parts = parts[:k] + [parts[k] + parts[k + 1]] + parts[k + 2:]
    return None


class Lattice:
    """Best paths through runs of characters that follow one another.

    ``begins`` marks the first character of each run; ``before`` maps the first character of a run to the piece that
    stands before it, where the cut there is not certain.
    """

    def __init__(self, model: Model, chars: np.ndarray, begins: np.ndarray, before: dict[int, int] | None = None) -> None:
        n = len(chars)
        self.first = np.maximum.accumulate(np.where(begins, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        ends = np.append(np.flatnonzero(begins)[1:], n)
        self.stop = np.repeat(ends, np.diff(np.append(np.flatnonzero(begins), n)))
        self._edges(model, chars)
        lead = np.full(n, -1, np.int64)
        for at, piece in (before or {}).items():
            lead[at] = piece
        depth = self.end - self.first[self.start]
        order = np.argsort(depth, kind="stable")
        self.valid = np.zeros(len(order), bool)
        self.into = np.full(n, -1, np.int64)  # edge that ends after each character
        for e in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []:
            start, piece = self.start[e], self.piece[e].astype(np.int64)
            opening = start == self.first[start]
            edge = np.where(opening, -1, self.into[start - 1])
            prior = np.where(opening, lead[start], np.where(edge >= 0, self.piece[edge], -1))
            good = opening | (edge >= 0)
            check = np.flatnonzero(good & (prior >= 0) & (piece >= 0))
            good[check] = model.stable(prior[check], piece[check])
            self.valid[e] = good
            self.into[self.end[e[good]] - 1] = e[good]

    def _edges(self, model: Model, chars: np.ndarray) -> None:
        """Every piece at every place; a character outside the vocabulary is piece -1."""
        n = len(chars)
        found = [(np.flatnonzero(chars < 0), 1, None)]
        at, state = np.flatnonzero(chars >= 0), 0
        length = 0
        while len(at):
            key = state * len(model.chars) + chars[at + length]
            k = np.minimum(np.searchsorted(model.step_key, key), len(model.step_key) - 1)
            there = model.step_key[k] == key
            at, state, length = at[there], model.step_to[k[there]], length + 1
            piece = model.piece_at[state]
            found.append((at[piece >= 0], length, piece[piece >= 0]))
            more = at + length < np.minimum(self.stop[at], n)
            at, state = at[more], state[more]
        self.start = np.concatenate([a for a, _, _ in found])
        self.end = np.concatenate([a + k for a, k, _ in found])
        self.piece = np.concatenate([np.full(len(a), -1, np.int32) if p is None else p for a, _, p in found])

    def trace(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first character, piece) along the paths that end after the characters ``last``."""
        steps = []
        while len(last):
            edge = self.into[last]
            start = self.start[edge]
            steps.append((start, self.piece[edge]))
            last = start[start > self.first[start]] - 1
        if not steps:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        start, piece = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(start)
        return start[order], piece[order]


def _with_bytes(model: Model, points: np.ndarray, start: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character, id): characters outside the vocabulary become their UTF-8 bytes."""
    unknown = np.flatnonzero(piece < 0)
    if not len(unknown):
        return start, piece
    raw = [chr(p).encode() for p in points[start[unknown]].tolist()]
    n = np.ones(len(piece), np.int64)
    n[unknown] = list(map(len, raw))
    ids = np.repeat(piece, n)
    ids[np.repeat(piece < 0, n)] = model.byte[np.frombuffer(b"".join(raw), np.uint8)]
    return np.repeat(start, n), ids


def solve(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts (spaces already replaced) one after another, and how many each has."""
    points, chars = model.char_numbers("".join(texts))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = model.certain_cuts(chars)
    begins[run_starts(lengths)[lengths > 0]] = True
    lattice = Lattice(model, chars, begins)
    last = np.append(np.flatnonzero(begins)[1:], len(chars)) - 1 if len(chars) else np.zeros(0, np.int64)
    start, ids = _with_bytes(model, points, *lattice.trace(last))
    return ids, np.bincount(np.repeat(np.arange(len(texts)), lengths)[start], minlength=len(texts))


class _Memory:
    """Ids of the words a worker has met, by their number."""

    def __init__(self) -> None:
        self.codes, self.ids, self.n, self.starts = Codes(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, model: Model) -> None:
        if len(self.codes.of) == len(self.n):
            return
        fresh = self.codes.words()[len(self.n):]
        texts = [(" " + w.decode()).replace(" ", SPACE) for w in fresh]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, BATCH_CHARS)))
        solved = [solve(model, texts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(texts)])]
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in solved)])
        self.n = np.concatenate([self.n, *(n for _, n in solved)])
        self.starts = run_starts(self.n)


@cache
def _memory(path: str) -> list[_Memory]:
    return [_Memory()]


def _words(model: Model, text: bytes) -> list[bytes]:
    """Words after the space that comes before every text, each without its first space."""
    text = text.replace(SPACE.encode(), b" ")
    if not text:
        return []
    if not model.words_apart:
        return [text]
    return text.split(b" ") if b"  " not in b" " + text + b" " else [w[1:] for w in _WORDS(b" " + text)]


def _encode_batches(batches: Iterator[pa.RecordBatch], model: Broadcast, path: str) -> Iterator[pa.RecordBatch]:
    held = _memory(path)
    for block in blocks(batches, "text"):
        words = [_words(model.value, text or b"") for text in utf8(block.column("text"))]
        ids, n = _solve_words(model.value, held, [w for ws in words for w in ws])
        doc = np.repeat(np.arange(len(block)), list(map(len, words)))
        counts = np.bincount(doc, weights=n, minlength=len(block)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([block.column("id"), nested(counts, pa.array(ids, pa.int32()))], ["id", "ids"])


def _solve_words(model: Model, held: list[_Memory], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another, and how many each has; words met before are not solved again."""
    if len(held[0].n) > REMEMBERED:
        held[0] = _Memory()
    memory = held[0]
    word = memory.codes.encode(words)
    memory.learn(model)
    n = memory.n[word]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return memory.ids[np.repeat(memory.starts[word] if len(word) else word, n) + nth], n


# Texts of several chunks.

def _chunk_batches(batches: Iterator[pa.RecordBatch], margin: int, size: int) -> Iterator[pa.RecordBatch]:
    """Chunks with the characters around their borders that a crossing piece can reach."""
    for batch in batches:
        for i in range(len(batch)):
            text = (" " + batch.column("text")[i].as_py()).replace(" ", SPACE)
            count = -(-len(text) // size)
            for c in range(count):
                a = c * size
                left = min(a, margin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, 1), batch.column("id").slice(i, 1), pa.array([c], pa.int64()), pa.array([left], pa.int64()),
                     pa.array([min(size, len(text) - a)], pa.int64()), pa.array([text[a - left:a + size + margin]])],
                    ["row", "id", "chunk", "left", "size", "text"])


class Chunk:
    """A chunk between places ``a`` and ``b`` of its characters, with margins on both sides."""

    def __init__(self, model: Model, left: int, size: int, text: str) -> None:
        self.model, self.a, self.b, self.text = model, left, left + size, text
        self.points, self.chars = model.char_numbers(text)
        self.cut = np.append(model.certain_cuts(self.chars), True)
        self.entries, self.exits = self._states(self.a), self._states(self.b)

    def _states(self, border: int) -> list[tuple[int, int, int]]:
        """Pieces that begin before a border and reach or cross it: (start, end, piece), in order.

        The text's own ends are one state without a piece.
        """
        if border in (0, len(self.chars)):
            return [(border, border, -1)]
        low = max(0, border - self.model.longest)
        near = self.chars[low:border + self.model.longest]
        e = Lattice.__new__(Lattice)
        e.stop = np.full(len(near), len(near))
        e._edges(self.model, near)
        hit = np.flatnonzero((e.start < border - low) & (e.end >= border - low))
        return sorted(zip((e.start[hit] + low).tolist(), (e.end[hit] + low).tolist(), e.piece[hit].tolist()))

    def paths(self, entry: tuple[int, int, int], stop: int | None = None) -> Lattice | None:
        """The lattice from the end of ``entry`` on, as positions from there."""
        _, begin, piece = entry
        stop = len(self.chars) if stop is None else stop
        if begin >= stop:
            return None
        begins = self.cut[begin:stop].copy()
        certain, begins[0] = begins[0], True
        return Lattice(self.model, self.chars[begin:stop], begins, None if certain or piece < 0 else {0: piece})

    def matrix(self) -> np.ndarray:
        """Weight (0 or minus infinity) from each state at the left border to each at the right.

        Entries agree behind the first certain cut after all of them, and exits depend only on the
        last one before all of them; between two certain cuts there is always a path. So only the two ends
        of a chunk are solved; one without such a cut is solved whole for each entry.
        """
        after = max(end for _, end, _ in self.entries)
        before = min(start for start, _, _ in self.exits)
        meet = after + int(np.argmax(self.cut[after:]))
        if meet <= before:
            part = before - int(np.argmax(self.cut[meet:before + 1][::-1]))
            lattice = self.paths((part, part, -1))
            left = [self._arrives(entry, meet) for entry in self.entries]
            right = [self._reaches(lattice, (part, part, -1), exit_) for exit_ in self.exits]
            open_ = np.outer(left, right)
        else:
            open_ = np.zeros((len(self.entries), len(self.exits)), bool)
            for i, entry in enumerate(self.entries):
                lattice = self.paths(entry)
                open_[i] = [self._reaches(lattice, entry, exit_) for exit_ in self.exits]
        return np.where(open_, 0.0, -np.inf)

    def _arrives(self, entry: tuple[int, int, int], stop: int) -> bool:
        lattice = self.paths(entry, stop)
        ends = np.flatnonzero(self.cut[entry[1] + 1:stop + 1])
        return lattice is None or bool((lattice.into[ends] >= 0).all())

    def _reaches(self, lattice: Lattice | None, entry, exit_) -> bool:
        begin = entry[1]
        start, end, piece = exit_
        if entry == exit_ or (piece < 0 and start == end == begin):
            return True
        if lattice is None or start < begin or (piece >= 0 or start != end) and end == begin:
            return False
        if start == end:  # the end of the text
            last = np.flatnonzero(self.cut[begin + 1:])
            return bool((lattice.into[last] >= 0).all())
        hit = np.flatnonzero((lattice.start == start - begin) & (lattice.end == end - begin) & (lattice.piece == piece))
        ends = np.flatnonzero(self.cut[begin + 1:start + 1]) if start > begin else np.zeros(0, np.int64)
        return bool(len(hit) and lattice.valid[hit[0]] and (lattice.into[ends] >= 0).all())

    def parts(self, entry: int, exit_: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The pieces that begin in this chunk, on the path between two states: ids, then whole words, then ids."""
        entry, exit_ = self.entries[entry], self.exits[exit_]
        if self.model.words_apart:
            space = np.frombuffer(self.text.encode("utf-32-le"), np.uint32) == ord(SPACE)
            starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            starts = starts[(starts > entry[1]) & (starts <= exit_[0])]
            if len(starts) > 1:
                p, q = int(starts[0]), int(starts[-1])
                inside = self.text[p + 1:q].replace(SPACE, " ").encode()
                return self._traced(entry, p), _words(self.model, inside), self._leaves((q, q, -1), exit_)
        return self._leaves(entry, exit_), [], np.zeros(0, np.int32)

    def ids(self, entry: int, exit_: int, held: list[_Memory] | None = None) -> np.ndarray:
        """Ids of those pieces, all traced in the lattice or with a memory of words."""
        if held is None:
            return self._leaves(self.entries[entry], self.exits[exit_])
        left, words, right = self.parts(entry, exit_)
        return np.concatenate([left, _solve_words(self.model, held, words)[0], right])

    def _traced(self, entry: tuple[int, int, int], stop: int) -> np.ndarray:
        """Ids from the end of ``entry`` to a certain cut."""
        begin = entry[1]
        ends = np.flatnonzero(self.cut[begin + 1:stop])
        return _with_bytes(self.model, self.points[begin:], *self.paths(entry, stop).trace(np.append(ends, stop - begin - 1)))[1]

    def _leaves(self, entry: tuple[int, int, int], exit_: tuple[int, int, int]) -> np.ndarray:
        start, end, piece = exit_
        begin = entry[1]
        lattice = self.paths(entry)
        steps_start, steps_piece = np.zeros(0, np.int64), np.zeros(0, np.int32)
        if lattice is not None and start > begin:
            ends = np.flatnonzero(self.cut[begin + 1:start])  # certain cuts strictly inside
            steps_start, steps_piece = lattice.trace(np.unique(np.append(ends, start - begin - 1)))
        if start < end and start >= self.a:
            steps_start, steps_piece = np.append(steps_start, start - begin), np.append(steps_piece, piece)
        return _with_bytes(self.model, self.points[begin:] if begin < len(self.points) else self.points,
                           steps_start.astype(np.int64), steps_piece.astype(np.int32))[1]


def _chunks_of(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            yield row, Chunk(model, *(row.column(c)[0].as_py() for c in ("left", "size", "text")))


def _matrix_batches(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for row, chunk in _chunks_of(batches, model.value):
        m = chunk.matrix()
        yield pa.RecordBatch.from_arrays(
            [row.column("row"), row.column("chunk"), pa.array([m.shape[1]], pa.int64()), pa.array([(m == 0).tobytes()], pa.binary())],
            ["row", "place", "width", "matrix"])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def border_states(matrices: list[np.ndarray], entry: int = 0, exit_: int = 0) -> list[int]:
    """State at each border of the best path from state ``entry`` of the first to ``exit_`` of the last."""
    start = np.full((1, len(matrices[0])), -np.inf)
    start[0, entry] = 0.0
    ahead = [start]
    for m in matrices:
        ahead.append(times(ahead[-1], m))
    states = [exit_]
    for m, reach in zip(reversed(matrices), reversed(ahead[:-1])):
        states.append(int(np.argmax(reach[0] + m[:, states[-1]])))
    return states[::-1]


def _matrices(table: pa.Table) -> list[np.ndarray]:
    pairs = zip(table.column("width").to_pylist(), table.column("matrix").to_pylist())
    return [np.where(np.frombuffer(data, bool).reshape(-1, width), 0.0, -np.inf) for width, data in pairs]


def _product(key: tuple, table: pa.Table) -> pa.Table:
    """The matrix of a run of at most FAN neighbours."""
    found = reduce(times, _matrices(table.sort_by("place")))
    return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "place": pa.array([key[1].as_py()], pa.int64()),
                     "width": pa.array([found.shape[1]], pa.int64()), "matrix": pa.array([(found == 0).tobytes()], pa.binary())})


def _inner_states(key: tuple, table: pa.Table) -> pa.Table:
    """States at the borders inside a run, from those at its two ends."""
    table = table.sort_by("place")
    states = border_states(_matrices(table), table.column("entry")[0].as_py(), table.column("exit")[0].as_py())
    return pa.table({"row": table.column("row"), "place": table.column("place"),
                     "entry": pa.array(states[:-1], pa.int64()), "exit": pa.array(states[1:], pa.int64())})


def _all_states(matrices: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, place, entry, exit) of every chunk, by products up a tree and states down it.

    No task sees more than FAN matrices of a text, however long it is.
    """
    above = F.expr(f"place div {FAN}")
    levels = [scratch.write(matrices, "matrices")]
    for _ in range(LEVELS - 1):
        levels.append(scratch.write(levels[-1].withColumn("above", above).groupBy("row", "above").applyInArrow(
            _product, levels[0].schema), "products"))
    ends = levels[-1].select("row", F.lit(0).cast("long").alias("place")).distinct().selectExpr("row", "place", "0L AS entry", "0L AS exit")
    for level in reversed(levels):
        ends = level.withColumn("above", above).join(ends.withColumnRenamed("place", "above"), ["row", "above"]).groupBy(
            "row", "above").applyInArrow(_inner_states, "row bigint, place bigint, entry bigint, exit bigint")
    return ends


def _trace_batches(batches: Iterator[pa.RecordBatch], model: Broadcast, path: str) -> Iterator[pa.RecordBatch]:
    found = _chunks_of(batches, model.value)
    while some := list(islice(found, TRACED)):
        parts = [chunk.parts(row.column("entry")[0].as_py(), row.column("exit")[0].as_py()) for row, chunk in some]
        words = [w for _, ws, _ in parts for w in ws]
        ids, n = _solve_words(model.value, _memory(path), words)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *(len(ws) for _, ws, _ in parts)])]
        for (row, _), (left, _, right), a, b in zip(some, parts, ends, ends[1:]):
            whole = np.concatenate([left, ids[a:b], right])
            yield pa.RecordBatch.from_arrays(
                [row.column("row"), row.column("id"), row.column("chunk"), nested(np.array([len(whole)]), pa.array(whole, pa.int32()))],
                ["row", "id", "chunk", "ids"])


@cache
def load(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id_col, ids): the model's ids for every row of ``docs``, without begin or end marks.

    ``path`` is a SentencePiece BPE model with byte fallback, a dummy prefix and no normalisation.
    Null and empty texts have no ids. Rows with an equal or null id stay rows of their own; extra columns are
    ignored. The result is that of the sentencepiece library.
    """
    spark = docs.sparkSession
    model = load(path)
    if chunk_chars < model.longest:
        raise ValueError("a chunk must be longer than any piece")
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(F.length("text") < chunk_chars).mapInArrow(
        partial(_encode_batches, model=sent, path=path), f"id {kind}, ids array<int>")
    scratch = Scratch(spark, "pieces")
    long = rows.where(F.length("text") >= chunk_chars).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    # Written before anything reads it twice: the row numbers then stay what they are.
    chunks = scratch.write(long.mapInArrow(
        partial(_chunk_batches, margin=model.longest, size=chunk_chars),
        f"row bigint, id {kind}, chunk bigint, left bigint, size bigint, text string").repartition("row", "chunk"), "chunks")
    matrices = chunks.select("row", "chunk", "left", "size", "text").mapInArrow(
        partial(_matrix_batches, model=sent), "row bigint, place bigint, width bigint, matrix binary")
    states = _all_states(matrices, scratch).withColumnRenamed("place", "chunk")
    traced = chunks.join(states, ["row", "chunk"]).mapInArrow(
        partial(_trace_batches, model=sent, path=path), f"row bigint, id {kind}, chunk bigint, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    whole = traced.groupBy("row").agg(F.first("id").alias("id"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    return short.unionByName(whole.select("id", "ids")).withColumnRenamed("id", id_col)


def _decode_batches(batches: Iterator[pa.RecordBatch], pieces: Broadcast) -> Iterator[pa.RecordBatch]:
    out = pieces.value
    for batch in (b.slice(i, DECODED_ROWS) for b in batches for i in range(0, len(b), DECODED_ROWS)):
        texts = []
        for ids in batch.column("ids"):
            text = b"".join(map(out.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else b""
            texts.append((text[1:] if text[:1] == b" " else text).decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", keep: list[str] = ()) -> DataFrame:
    """(id_col, kept columns, text): the text of each list of ids.

    It is the text that was encoded, with U+2581 as a space; null ids give an empty text.
    """
    rows = encoded.select(*dict.fromkeys([id_col, "ids", *keep]))
    sent = encoded.sparkSession.sparkContext.broadcast(load(path).out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(partial(_decode_batches, pieces=sent), f"{fields}, text string").select(
        *dict.fromkeys([id_col, *keep]), "text")
