"""Evaluation order of expensive expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns in a one-row generator.

    The optimizer neither merges a later projection into a generator nor pushes a filter
    below its output, so an expensive expression is neither repeated nor inlined into
    every place that reads it.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
