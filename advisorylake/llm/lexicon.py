"""Toxicity: misspelt lexicon terms found by automata, weighed by their context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain, islice, repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from advisorylake.llm.texts import Codes, alnum_words, blocks, lower_ascii, nested, utf8
from advisorylake.session import Scratch

#: Labelled rows (the first by the hash of their id) from which the model is learned.
LABELLED_ROWS = 20_000
#: Lengths of stems, sizes of the model's parts, and the least number of toxic documents of a stem.
SHORTEST, LONGEST = 4, 12
CANDIDATES, STEMS, CUES = 50_000, 1000, 2000
LEAST_DOCS = 4
#: A stem is taken up if toxic documents have it this many times as often as others.
LEAST_RATIO = 6.0
#: And if that has so much evidence: among a million stems, chance reaches about 14.
LEAST_SURPRISE = 16.0
#: One edit is allowed in stems of this length or more.
FUZZY_LENGTH = 5
#: Words on either side of a match that make its context.
CONTEXT = 6
REMEMBERED = 400_000
QUOTE = b'"'
_QUOTES = ("“", "”", "„", "«", "»", "‘", "’")
_TOKENS = re.compile(rb'[a-z0-9\x80-\xff]+|"').findall


def plain_text(text: bytes) -> bytes:
    for quote in _QUOTES:
        text = text.replace(quote.encode(), QUOTE)
    return lower_ascii(text)


class Trie:
    """Stems, and the search for words that begin with one of them, one edit allowed."""

    def __init__(self, stems: Iterable[str]) -> None:
        self.stems = list(stems)
        self.root: dict = {}
        # Halves of stems: after one edit one of the two stands unchanged, at most one place off.
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[tuple[int, int], set[str]] = {}
        self.pairs: dict[int, set[str]] = {}  # the first two letters of tails, by their place
        for number, stem in enumerate(self.stems):
            node = self.root
            for char in stem:
                node = node.setdefault(char, {})
            node[""] = number
            half = len(stem) // 2 if len(stem) >= FUZZY_LENGTH else len(stem)
            self.heads.setdefault(half, set()).add(stem[:half])
            if half < len(stem):
                self.tails.setdefault((half, len(stem) - half), set()).add(stem[half:])
                for place in (half - 1, half, half + 1):
                    self.pairs.setdefault(place, set()).add(stem[half:half + 2])

    def possible(self, word: str) -> bool:
        """False only if no stem can match; spares most words the search."""
        for n, heads in self.heads.items():
            if word[:n] in heads:
                return True
        for place, pairs in self.pairs.items():
            if word[place:place + 2] in pairs:
                return any(word[at + shift:at + shift + n] in tails
                           for (at, n), tails in self.tails.items() for shift in (-1, 0, 1))
        return False

    def find(self, word: str) -> tuple[int, int] | None:
        """(stem, edits) of the best match of any beginning of ``word``: fewest edits, longest stem.

        Walks the trie together with the Levenshtein automaton of the word. A state of the
        automaton is two sets of places of the word, as bits: those the walked letters reach without an edit, and with one.
        """
        best: tuple[int, int, int] | None = None
        here: dict[str, int] = {}
        for place, char in enumerate(word):
            here[char] = here.get(char, 0) | 1 << place
        inside = (1 << len(word) + 1) - 1
        stack = [(self.root, 0, 1, 2 & inside)]
        while stack:
            node, depth, exact, one = stack.pop()
            for char, child in node.items():
                if char == "":
                    if (exact or (one and depth >= FUZZY_LENGTH)) and (best is None or (not exact, -depth) < best[:2]):
                        best = (not exact, -depth, child)
                    continue
                at = here.get(char, 0)
                same = (exact & at) << 1
                # After an edit: match. With a fresh one: replace a letter, leave it out, or add one.
                edited = ((one & at) << 1 | exact << 1 | exact | same << 1) & inside & ~same
                if same or edited:
                    stack.append((child, depth + 1, same, edited))
        return None if best is None else (best[2], int(best[0]))


class Matches:
    """Best match of every word that a worker has met, by the word's number."""

    def __init__(self, stems: Iterable[str]) -> None:
        self.trie = Trie(stems)
        self.forget()

    def forget(self) -> None:
        # The last entry stands for tokens that are no words.
        self.codes, self.stem, self.edits = Codes(), np.full(1, -1, np.int32), np.zeros(1, np.int8)

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Stem (-1: none) of each word."""
        code = self.codes.encode(words)
        fresh = islice(self.codes.of, len(self.stem) - 1, None)
        found = [(self.trie.find(w) if self.trie.possible(w) else None) or (-1, 0)
                 for w in map(partial(bytes.decode, errors="replace"), fresh)]
        if found:
            stem, edits = zip(*found)
            self.stem = np.concatenate([self.stem[:-1], np.array(stem, np.int32), [-1]])
            self.edits = np.concatenate([self.edits[:-1], np.array(edits, np.int8), [0]])
        return self.stem[code]

    def known(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Stem and edits of tokens whose words have been learned."""
        code = np.fromiter(map(self.codes.of.get, tokens, repeat(-1)), np.int64, len(tokens))
        return self.stem[code], self.edits[code]


@lru_cache(maxsize=1)
def _matches(stems: tuple[str, ...]) -> Matches:
    """One memory for all tasks of a worker."""
    return Matches(stems)


class Prefixes:
    """Stems that the words of a text begin with: all of them, or the wanted ones."""

    def __init__(self, wanted: frozenset[str] | None) -> None:
        self.wanted, self.of_word = wanted, {}

    def of(self, text: bytes | None) -> set[str]:
        words = set(alnum_words(plain_text(text or b"")))
        if len(self.of_word) > REMEMBERED:
            self.of_word.clear()
        for word in words - self.of_word.keys():
            letters = word.decode(errors="replace")
            stems = {letters[:n] for n in range(SHORTEST, min(len(letters), LONGEST) + 1)}
            self.of_word[word] = tuple(stems if self.wanted is None else stems & self.wanted)
        return set(chain.from_iterable(map(self.of_word.__getitem__, words)))


def _stem_batches(batches: Iterator[pa.RecordBatch], wanted: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Documents per stem: of all stems, or of the wanted ones."""
    total: Counter[str] = Counter()
    prefixes = Prefixes(wanted.value if wanted else None)
    for batch in batches:
        for text in utf8(batch.column("text")):
            total.update(prefixes.of(text))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                     ["stem", "n"])


def stem_counts(docs: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    parts = docs.select("text").mapInArrow(partial(_stem_batches, wanted=wanted), "stem string, n bigint")
    return parts.groupBy("stem").agg(F.sum("n").alias("n"))


def learn_stems(toxic: DataFrame, clean: DataFrame) -> dict[str, float]:
    """Stems of toxic documents with the log of how much more often those have them.

    Of stems that extend one another and stand in the same documents the longest stays.
    """
    n_toxic, n_clean = toxic.count(), clean.count()
    ranked = stem_counts(toxic).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "stem").limit(CANDIDATES)
    seen = {r["stem"]: r["n"] for r in ranked.collect()}
    sent = toxic.sparkSession.sparkContext.broadcast(frozenset(seen))
    others = {r["stem"]: r["n"] for r in stem_counts(clean, sent).collect()}  # CANDIDATES rows at most
    odds = {s: log((n + 0.5) / (n_toxic + 1)) - log((others.get(s, 0) + 0.5) / (n_clean + 1)) for s, n in seen.items()}
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)
    good = {s for s, n in seen.items() if odds[s] >= log(LEAST_RATIO) and _surprise(n, others.get(s, 0), base) >= LEAST_SURPRISE}
    longer = Counter()
    for s in good:
        longer[s[:-1]] = max(longer[s[:-1]], seen[s])
    kept: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        shorter = [s[:k] for k in range(SHORTEST, len(s)) if s[:k] in kept]
        # A stem gives way to one that is a letter longer and as frequent; beside a shorter one it must say more.
        if longer[s] < 0.9 * seen[s] and (not shorter or odds[s] >= odds[shorter[-1]] + 1):
            kept[s] = odds[s]
    best = sorted(kept, key=lambda s: (-seen[s] * odds[s], s))[:STEMS]
    return {s: odds[s] for s in sorted(best)}


def _surprise(toxic: int, clean: int, base: float) -> float:
    """Log likelihood ratio of the toxic share of a stem's documents against the share of all."""
    share = toxic / (toxic + clean)
    return toxic * log(share / base) + (clean * log((1 - share) / (1 - base)) if clean else 0.0)


def occurrences(texts: list[bytes], matches: Matches) -> Iterator[list[tuple[int, int, set[bytes]]]]:
    """For each text (stem, edits, context) of its matched words.

    A quotation mark nearby is part of the context.
    """
    if len(matches.stem) > REMEMBERED:
        matches.forget()
    plain = [plain_text(t) for t in texts]
    words = [alnum_words(t) for t in plain]
    stem = matches.learn(list(chain.from_iterable(words)))
    hit = np.bincount(np.repeat(np.arange(len(words)), list(map(len, words))), weights=stem >= 0, minlength=len(words)) > 0
    for text, some in zip(plain, hit.tolist()):
        tokens = _TOKENS(text) if some else []
        stem, edits = matches.known(tokens)
        yield [(int(stem[at]), int(edits[at]), set(tokens[max(0, at - CONTEXT):at] + tokens[at + 1:at + 1 + CONTEXT]))
               for at in np.flatnonzero(stem >= 0).tolist()]


def _cue_batches(batches: Iterator[pa.RecordBatch], stems: Broadcast) -> Iterator[pa.RecordBatch]:
    matches = _matches(tuple(stems.value))
    total: dict[bool, Counter[bytes]] = {True: Counter(), False: Counter()}
    for block in blocks(batches, "text"):
        texts = [t or b"" for t in utf8(block.column("text"))]
        for found, toxic in zip(occurrences(texts, matches), block.column("toxic").to_pylist()):
            for _, _, around in found:
                total[toxic].update(around | {b""})
    words = sorted(total[True].keys() | total[False].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(words, pa.binary()), *(pa.array([total[k][w] for w in words], pa.int64()) for k in (True, False))],
        ["cue", "toxic", "clean"])


def learn_cues(labelled: DataFrame, stems: dict[str, float]) -> dict[bytes, float]:
    """Context words that tell matches in toxic documents from those in others, with log odds.

    Where lexicon terms are quoted or reported, marks and reporting words near them weigh against abuse.
    """
    sent = labelled.sparkSession.sparkContext.broadcast(list(stems))
    parts = labelled.select("text", "toxic").mapInArrow(partial(_cue_batches, stems=sent), "cue binary, toxic bigint, clean bigint")
    counts = parts.groupBy("cue").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = counts.orderBy(F.desc(F.col("toxic") + F.col("clean")), "cue").limit(CUES).collect()
    total = next((r for r in rows if bytes(r["cue"]) == b""), None)
    if total is None or not min(total["toxic"], total["clean"]):
        return {}
    odds = {bytes(r["cue"]): log((r["toxic"] + 1) / (total["toxic"] + 2)) - log((r["clean"] + 1) / (total["clean"] + 2))
            for r in rows if bytes(r["cue"])}
    return {w: o for w, o in odds.items() if abs(o) >= 1}


N_FEATURES = 9


def document_features(size: int, found: list, odds: np.ndarray, cues: dict[bytes, float]) -> list[float]:
    """For exact and for misspelt matches: best log odds, context score there, their number, and the evidence of all
    distinct stems; and the length of the text, as long texts meet stems by chance."""
    best, context, times = [0.0, 0.0], [0.0, 0.0], [0, 0]
    met: tuple[set[int], set[int]] = (set(), set())
    for stem, edits, around in found:
        nearby = min(3.0, max(-3.0, sum(cues.get(w, 0.0) for w in around)))
        times[edits] += 1
        met[edits].add(stem)
        if times[edits] == 1 or odds[stem] + nearby > best[edits] + context[edits]:
            best[edits], context[edits] = float(odds[stem]), nearby
    evidence = [min(20.0, float(sum(odds[s] for s in stems))) for stems in met]
    return [x for k in (0, 1) for x in (best[k], context[k], float(np.log1p(times[k])), evidence[k])] + [
        float(np.log1p(size))]


def _feature_batches(batches: Iterator[pa.RecordBatch], model: Broadcast, carry: list[str]) -> Iterator[pa.RecordBatch]:
    stems, cues = model.value
    matches, odds = _matches(tuple(stems)), np.array(list(stems.values()))
    for block in blocks(batches, "text"):
        texts = [t or b"" for t in utf8(block.column("text"))]
        found = [document_features(len(t), hits, odds, cues) for t, hits in zip(texts, occurrences(texts, matches))]
        lists = pa.array(np.array(found, np.float64).ravel())
        yield pa.RecordBatch.from_arrays([*(block.column(c) for c in carry), nested(np.full(len(block), N_FEATURES), lists)],
                                         [*carry, "features"])


def features(docs: DataFrame, model: Broadcast, carry: list[str]) -> DataFrame:
    rows = docs.select(*carry, "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(partial(_feature_batches, model=model, carry=carry), f"{fields}, features array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``.

    Stems, context cues and the weights of both are learned from ``labelled_rows`` labelled rows at most whose
    crc32(id) mod 5 is not 0. Texts are searched whole. A null or empty text has no matches and gets the
    score of such texts; without labels of both kinds every score is the share of label 1 (0 without
    labels). Repeated rows get equal scores; rows without id count as held out by the crc32 of an
    empty key. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexicon")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    marks = usable.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("toxic"))
    sample = marks.orderBy(F.xxhash64("id"), "id").limit(labelled_rows)
    labelled = scratch.write(rows.join(F.broadcast(sample), "id").select("text", "toxic"), "labelled")
    toxic, clean = labelled.where("toxic"), labelled.where(~F.col("toxic"))
    stems = learn_stems(toxic, clean)
    cues = learn_cues(labelled, stems) if stems else {}
    model = spark.sparkContext.broadcast((stems, cues))
    # At most labelled_rows rows of N_FEATURES numbers, unless documents are repeated.
    known = features(labelled, model, ["toxic"]).groupBy("toxic", "features").agg(F.count("*").alias("n")).collect()
    x = np.array([r["features"] for r in known for _ in range(r["n"])]).reshape(-1, N_FEATURES)
    y = np.array([float(r["toxic"]) for r in known for _ in range(r["n"])])
    if 0 < y.sum() < len(y):
        weights = fit(x, y)
    else:
        share = y.mean() if len(y) else 0.0
        weights = np.append(np.zeros(N_FEATURES), 30.0 if share else -30.0)
    terms = [F.element_at("features", k + 1) * F.lit(float(w)) for k, w in enumerate(weights[:-1])]
    total = sum(terms, F.lit(float(weights[-1])))
    scored = scratch.write(features(rows, model, ["id"]).select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), (1 / (1 + F.exp(-total))).alias("score")), "scores")
    scratch.keep_only(scored)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
