"""Accents are folded in small parts of an Arrow batch."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from advisorylake.functions import software


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_parts(monkeypatch, size):
    monkeypatch.setattr(software, "FOLD_BYTES", size, raising=False)
    texts = ["Über", None, "", "ﬁx ½", "́", "日本", "Ñandú" * 3]
    got = software._fold_accents.func(pa.array(texts, pa.string()))
    assert got.to_pylist() == ["Uber", None, "", "fix 12", "", "", "Nandu" * 3]
    assert software._fold_accents.func(pa.array([], pa.string())).to_pylist() == []


def test_key(spark):
    rows = spark.createDataFrame([("Über  Tool",), ("plain_One",), (None,), ("",), ("日本",)], "s string")
    assert [r.k for r in rows.select(software.normalize_key(F.col("s")).alias("k")).collect()] == ["uber tool", "plain one", None, "", ""]
