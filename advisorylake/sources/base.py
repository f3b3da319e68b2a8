"""Readers of landed raw files and the shape every scan returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from advisorylake.functions.text import blank_to_null
from advisorylake.schemas import AFFECTED_ITEM, FLAGS, MENTION_SCHEMA

TITLE_CAP, SNIPPET_CAP, REFERENCE_CAP = 200, 2000, 50


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: ``raw`` text and the path it came from."""
    reader = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("value").alias("raw"),
                                    F.col("_metadata.file_path").alias("path"),
                                    F.col("_metadata.file_name").alias("file_name"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, for JSON-lines landings; splits across tasks."""
    return spark.read.text(path).select(F.col("value").alias("raw"))


def mentions_frame(df: DataFrame, carry: list[str] = (), **columns: Column) -> DataFrame:
    """MENTION_SCHEMA from the given columns; the rest is null."""
    unknown = set(columns) - set(MENTION_SCHEMA.names)
    if unknown:
        raise ValueError(f"not mention columns: {sorted(unknown)}")
    out = [F.col(c) for c in carry]
    for field in MENTION_SCHEMA:
        out.append(columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name))
    return df.select(*out)


def title_of(*choices: Column) -> Column:
    """First non-empty choice, cut to the title length."""
    return F.left(F.coalesce(*[blank_to_null(c) for c in choices]), F.lit(TITLE_CAP))


def snippet_of(text: Column) -> Column:
    return F.left(blank_to_null(text), F.lit(SNIPPET_CAP))


def affected_item(**columns: Column) -> Column:
    parts = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in AFFECTED_ITEM]
    return F.struct(*parts)


def flags_of(**columns: Column) -> Column:
    parts = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FLAGS]
    return F.struct(*parts)
