"""Counts of pieces against the tokenizer on whole texts."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from advisorylake.llm import token_counts as tc

PATH = public_tokenizers.path(tc.TOKENIZER)
PARTS = ["the", "Été", "don't", "'s", "x" * 40, "中文字", "é", "́", "ﬁ", "İ", "ΑΣ", "12a", "<|endoftext|>",
         "<|startoftext|>a", "a<|endoftext|>", "!!!", "👩‍👩‍👧", " ", " ", "\x85", "\x1c", "​", "한글", "<|endof", "text|>"]
BLANKS = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", ""]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_whole_texts(spark, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PARTS) + rnd.choice(BLANKS) for _ in range(rnd.randrange(0, 60))) for _ in range(150)]
    texts += ["", " ", "\n\n", "word " * 40_000, "x" * 100_000, texts[0]]
    rows = [(i, t, 7, "c") for i, t in enumerate(texts)] + [(None, None, 7, "c"), (0, texts[0], 7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    whole = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in rows:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    got = [tuple(r) for r in tc.token_counts(docs, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_small_memory_changes_nothing(monkeypatch):
    pieces = [f"word{i}".encode() for i in range(50)]
    whole = tc._lengths(pieces, PATH).tolist()
    monkeypatch.setattr(tc, "REMEMBERED", 10)
    monkeypatch.setattr(tc, "BATCH_BYTES", 20)
    assert tc._lengths(pieces, PATH).tolist() == whole
