"""Ingestion into stored tables, batch by batch: identifiers, candidates, mentions, products and references.

Components of identifiers are kept as a forest of pointers, so a batch touches only the components that its identifiers
reach. All tables of a batch are committed by one journal entry. The candidate of a component is named by the hash of its
smallest identifier; when a smaller one arrives the old name becomes a tombstone. So the live candidates do not depend on how
mentions were cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from advisorylake.operators import merge as M
from advisorylake.operators.ingest import mention_dedup, prepare, soft_references
from advisorylake.operators.resolve import connected_components, identity_edges, merge_reassign, node_key
from advisorylake.operators.versioned import Journal, Pending, VersionedTable
from advisorylake.session import Scratch

PRODUCT = ("candidate_id string, vendor string, product string, ecosystem string, purl string, kind string, exact_versions array<string>, "
           "ranges array<struct<introduced: string, fixed: string, last_affected: string, version_type: string, raw: string>>, source string")
#: Tables with their columns, key, and the columns that choose a bucket.
TABLES = {
    "links": ("node string, root string", ["node"], ["node"]),
    "moves": ("root string, next string", ["root"], ["root"]),
    "mentions": ("source_id int, content_hash string, anchor string, url string, title string, snippet string, extracted_cve string, "
                 "extracted_native string, arrival bigint", ["source_id", "content_hash"], ["content_hash"]),
    "soft_refs": ("source_id int, content_hash string, cve_id string, context string", ["source_id", "content_hash", "cve_id"], ["content_hash"]),
    "sightings": ("root string, source_id int, n bigint, first bigint, last bigint", ["root", "source_id"], ["root"]),
    "products": (PRODUCT, M.AFFECTED_KEY, ["candidate_id"]),
}


class StoredForest:
    """Components as pointers: ``links`` leads from an identifier to a root, ``moves`` from a root to a smaller one.

    A root is the smallest identifier of its component at the time it was written. Identifiers that a batch does not name keep
    their link and follow the moves.
    """

    def __init__(self, links: VersionedTable, moves: VersionedTable) -> None:
        self.links, self.moves = links, moves

    def _chase(self, placed: DataFrame, scratch: Scratch) -> DataFrame:
        """(node, root) with every root replaced by the one its moves end at."""
        while True:
            step = scratch.write(self.moves.lookup(placed.where("root IS NOT NULL").select("root").distinct()), "step")
            if step.isEmpty():
                return placed
            placed = scratch.write(placed.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "placed")

    def find(self, nodes: DataFrame, scratch: Scratch) -> DataFrame:
        """(node, root) of distinct nodes; the root of an unknown node is null."""
        return self._chase(scratch.write(nodes.join(self.links.lookup(nodes.select("node")), "node", "left").select("node", "root"), "found"), scratch)

    def components(self, scratch: Scratch) -> DataFrame:
        """(node, root) of every stored identifier."""
        return self._chase(scratch.write(self.links.read(), "all"), scratch)

    def stage(self, edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict[str, Pending]]:
        """(node, root) of the batch, (root, next) of the roots that moved, and the staged tables.

        The graph has one node for each component that the batch reaches, however large it is.
        """
        a, b = edges.columns
        ends = scratch.write(edges.select(F.col(a).alias("node")).union(edges.select(b)).union(nodes).distinct(), "ends")
        found = self.find(ends, scratch).withColumn("known", F.col("root").isNotNull()).withColumn("top", F.coalesce("root", "node"))
        top = lambda c: found.select(F.col("node").alias(c), F.col("top").alias(f"{c}_top"))
        between = scratch.write(edges.join(top(a), a).join(top(b), b).select(f"{a}_top", f"{b}_top"), "between")
        labels = scratch.write(connected_components(between, found.select("top"))[0], "labels")
        named = labels.select(F.col("node").alias("top"), "component")
        placed = scratch.write(found.join(named, "top").select("node", F.col("component").alias("root")), "labelled")
        moved = scratch.write(found.where("known").select("top").distinct().join(named, "top").where("top <> component").select(
            F.col("top").alias("root"), F.col("component").alias("next")), "moved")
        return placed, moved, {
            "links": self.links.stage(placed, lambda old, new: M.merge(old, new, ["node"], {"root": M.new})),
            "moves": self.moves.stage(moved, lambda old, new: M.merge(old, new, ["root"], {"next": M.new}))}


def _with_moves(changes: DataFrame, moved: DataFrame, root: str) -> DataFrame:
    """Changes, and rows that name both ends of every move, so that their buckets are read."""
    ends = moved.select(F.col("root").alias(root), F.col("next").alias("moved_to")).unionByName(
        moved.select(F.col("next").alias(root), F.lit(None).cast("string").alias("moved_to")))
    return changes.withColumn("is_row", F.lit(True)).unionByName(ends.withColumn("is_row", F.lit(False)), allowMissingColumns=True)


def add_sightings(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts by (root, source) after the moves and the new mentions of a batch."""
    moves = changes.where("moved_to IS NOT NULL").select("root", "moved_to")
    here = old.join(moves, "root", "left").withColumn("root", F.coalesce("moved_to", "root")).drop("moved_to")
    return here.unionByName(changes.where("is_row").select(*old.columns)).groupBy("root", "source_id").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def add_products(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Products under their component after the moves, then the batch's own, which overwrite."""
    moves = changes.where("moved_to IS NOT NULL").select(F.col("candidate_id").alias("id"), F.col("moved_to").alias("root"))
    here = merge_reassign(old, moves, ["vendor", "product", "ecosystem"])
    return M.merge_affected_structured(here, changes.where("is_row").drop("moved_to", "is_row"))


class IngestStore:
    """Stored tables under ``path`` and the batches that changed them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.tables = {name: VersionedTable(spark, f"{path}/{name}") for name in TABLES}
        self.forest = StoredForest(self.tables["links"], self.tables["moves"])
        self.journal = Journal(spark, f"{path}/journal", self.tables)

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64) -> IngestStore:
        for name, (schema, key, cluster) in TABLES.items():
            VersionedTable.create(spark.createDataFrame([], schema), f"{path}/{name}", key, buckets, cluster)
        return cls(spark, path)

    def ingest(self, mentions: DataFrame, batch: int, aliases: DataFrame | None = None) -> bool:
        """Apply a batch of mentions (with source_id and arrival); False if the journal holds its number already.

        ``aliases`` holds ``ids`` known to belong together; they link candidates but count as no mention.
        Identifiers, moves, new mentions, references, counts and products are staged first and become visible together.
        """
        self.journal.recover()
        if self.journal.last() >= batch:
            return False
        scratch = Scratch(self.spark, "ingest")
        prepared = scratch.write(prepare(mentions), "prepared")
        declared = prepared.select("ids")
        edges, nodes = identity_edges(declared if aliases is None else declared.unionByName(aliases))
        placed, moved, pending = self.forest.stage(edges, nodes, scratch)
        first = F.get("ids", F.lit(0))
        owned = scratch.write(prepared.withColumn("anchor", node_key(first["scheme"], first["value"])).join(
            placed.withColumnRenamed("node", "anchor"), "anchor"), "owned")
        stored = self.tables["mentions"].lookup(owned.select("source_id", "content_hash"))
        fresh = scratch.write(mention_dedup(owned, stored), "fresh")
        put = lambda name, changes, rule: pending.update({name: self.tables[name].stage(changes, rule)})
        put("mentions", fresh.select(*self.tables["mentions"].read().columns), lambda old, new: M.insert_new(old, new, ["source_id", "content_hash"]))
        soft = soft_references(fresh.withColumn("mention_id", F.struct("source_id", "content_hash"))).select("mention_id.*", "cve_id", "context")
        key = ["source_id", "content_hash", "cve_id"]
        put("soft_refs", soft.dropDuplicates(key), lambda old, new: M.insert_new(old, new, key))
        seen = fresh.groupBy("root", "source_id").agg(F.count("*").alias("n"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))
        put("sightings", _with_moves(seen, moved, "root"), add_sightings)
        if "affected" in owned.columns:
            items = M.structured_affected(owned.where("affected IS NOT NULL").withColumn("candidate_id", F.col("root")))
            put("products", _with_moves(items, moved, "candidate_id"), add_products)
        self.journal.commit(batch, pending)
        scratch.keep_only()
        return True

    def candidates(self) -> DataFrame:
        """Live candidates: id, cve_id, status, mention_count, source_count, first_arrival, last_arrival."""
        return self.tables["sightings"].read().groupBy("root").agg(
            F.sum("n").alias("mention_count"), F.count("*").alias("source_count"), F.min("first").alias("first_arrival"),
            F.max("last").alias("last_arrival")).select(
            F.sha2("root", 256).alias("id"), F.when(F.col("root").startswith("I|CVE|"), F.expr("substring(root, 7)")).alias("cve_id"),
            F.lit("emerging").alias("status"), "mention_count", "source_count", "first_arrival", "last_arrival")

    def tombstones(self) -> DataFrame:
        """(id, merged_into) of every name that a candidate had before."""
        scratch = Scratch(self.spark, "tombstones")
        ends = self.forest._chase(scratch.write(self.tables["moves"].read().select(F.col("root").alias("node"), F.col("next").alias("root")), "moves"), scratch)
        return ends.select(F.sha2("node", 256).alias("id"), F.sha2("root", 256).alias("merged_into"))

    def products(self) -> DataFrame:
        return self.tables["products"].read().withColumn("candidate_id", F.sha2("candidate_id", 256))
