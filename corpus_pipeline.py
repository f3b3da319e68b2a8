"""From raw documents to token ids in five stages; each stage works on what the one before kept.

Rows without a doc_id can't be told apart and leave in the first stage; of rows that share
one, that with the smallest hash of its content stays. Null and empty texts pass every stage but leave as near duplicates of each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from advisorylake.llm import anchors, importance, near_copies, piece_scan, postings
from advisorylake.session import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = importance.resample(docs, labels).where("kept").select("doc_id").distinct()
    others = [c for c in docs.columns if c != "doc_id"]
    content = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in others])
    one = docs.join(kept, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*others), content).alias("d"))
    return one.select("doc_id", "d.*").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by a similarity of 0.8 or more in 5-word shingles."""
    return docs.join(near_copies.survivors(docs).hint("merge"), "doc_id", "left_semi")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document that consists of nothing else goes."""
    cut = anchors.cut_repeats(docs).where("n_removed = 0 OR n_removed < n_words").select(
        "doc_id", F.when(F.col("n_removed") > 0, F.col("kept")).alias("rest"))
    joined = docs.join(cut, "doc_id").withColumn("text", F.coalesce("rest", "text"))
    size = F.when(F.col("rest").isNotNull(), F.length("rest")).otherwise(F.col("n_chars"))
    return joined.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark items."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # The few that go are written first, so that Spark knows how few they are and shuffles no text to leave them out.
    gone = Scratch(spark, "decontamination").write(postings.contamination(docs, tests).where("contaminated").select("doc_id"), "gone")
    return docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the hash of the text that decoding the ids gives back."""
    path = public_tokenizers.path(piece_scan.MODEL)
    decoded = piece_scan.decode(piece_scan.encode(docs, path), path, keep=["ids"])
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("text_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]

#: The first stage draws by a fitted model and the last follows a model file; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.keep_only(docs)
    return docs
