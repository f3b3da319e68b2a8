"""Entity resolution: connected components over declared identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from advisorylake.operators.aggregates import member_rank, merge_winner
from advisorylake.session import Scratch, cut_lineage

def _with_min(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) pairs plus ``m``, the smallest node of u's neighbourhood including u.

    The minima combine on the map side and are written, so both sides of the join are
    plain shuffles and the adaptive skew join splits the rows of a hub.
    """
    lowest = pairs.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("m"))
    return pairs.join(scratch.write(lowest, "lowest"), "u")


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    hooked = _with_min(both, scratch).where(F.col("v") > F.col("u"))
    return hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    hooked = _with_min(edges, scratch)
    ends = F.when(F.col("v") == F.col("m"), F.array("u")).otherwise(F.array("u", "v"))
    return hooked.select(F.explode(ends).alias("u"), F.col("m").alias("v")).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, vertices: DataFrame | None = None
                         ) -> tuple[DataFrame, int]:
    """(node, component) with the smallest node as label, and the rounds it took.

    Alternating star contraction: each round turns neighbourhoods into stars around
    their smallest node, so long chains and huge hubs both collapse in a logarithmic
    number of rounds and the edge count never grows. It ends when a round changes nothing.
    Rounds end in files of the shared folder, so losing an executor costs one round at
    most; the files of earlier rounds are removed.
    """
    a, b = edges.columns[:2]
    scratch = Scratch(edges.sparkSession, "components")
    current = scratch.write(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") != F.col("v")).distinct(), "edges")
    rounds, before, now = 0, None, _checksum(current)
    while now != before and now[0]:
        rounds += 1
        hooked = scratch.write(_large_star(current, scratch), "large")
        current = scratch.write(_small_star(hooked, scratch), "small")
        scratch.keep_only(current)
        before, now = now, _checksum(current)
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = labels.union(roots)
    if vertices is not None:
        node = vertices.columns[0]
        lone = vertices.select(F.col(node).alias("node")).distinct().join(
            out.select("node"), "node", "left_anti")
        out = out.union(lone.select("node", F.col("node").alias("component")))
    return out, rounds


def follow_tombstones(candidates: DataFrame) -> DataFrame:
    """(id, root): every candidate with the live candidate its merge chain ends at.

    Pointers are squared each round, so a chain of length n settles in log n rounds. The
    loop ends when no pointer moves, or when only cycles are left, which never shrink and
    have no live root; rows of a cycle have a null root.
    """
    scratch = Scratch(candidates.sparkSession, "tombstones")
    links = scratch.write(candidates.where(F.col("merged_into").isNotNull()).select(
        F.col("id"), F.col("merged_into").alias("root"), F.lit(True).alias("moved")), "links")
    still_open = None
    while True:
        step = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        links = scratch.write(links.drop("moved").join(step, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "links")
        scratch.keep_only(links)
        moved = links.where("moved").count()
        if moved in (0, still_open):
            break
        still_open = moved
    live = candidates.where(F.col("merged_into").isNull()).select("id", F.col("id").alias("root"))
    return live.unionByName(links.select(
        "id", F.when(~F.col("moved"), F.col("root")).alias("root")))


def node_key(scheme: Column, value: Column) -> Column:
    return F.concat(F.lit("I|"), scheme, F.lit("|"), value)


def identity_edges(identified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Star edges first id -> other ids of each mention, and all identifier nodes.

    Expects ``ids`` as array<struct<scheme,value>>. Repeated declarations of the same ids
    collapse before any shuffle of edges.
    """
    keys = identified.select(
        F.transform("ids", lambda i: node_key(i["scheme"], i["value"])).alias("k")).where(
        F.size("k") > 0)
    nodes = keys.select(F.explode("k").alias("node")).distinct()
    edges = keys.where(F.size("k") > 1).select(
        F.get("k", F.lit(0)).alias("a"), F.explode(F.slice("k", 2, F.size("k"))).alias("b")).distinct()
    return edges, nodes


def live_owners(identifiers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Identifiers with the live candidate at the end of their owner's merge chain.

    Only owners that are tombstones are followed; most rows keep their owner.
    """
    roots = follow_tombstones(candidates.select("id", "merged_into")).where(
        F.col("root").isNotNull() & (F.col("root") != F.col("id")))
    return identifiers.join(roots.withColumnRenamed("id", "candidate_id"), "candidate_id", "left").withColumn(
        "candidate_id", F.coalesce("root", "candidate_id")).select(*identifiers.columns)


def resolve_identifiers(identified: DataFrame, identifiers: DataFrame | None = None,
                        candidates: DataFrame | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """Identifier -> candidate for a batch, and loser -> winner for merged candidates.

    Known identifiers pull the live ends of their candidates' merge chains into the
    components, so a tombstone never wins. A component without a
    candidate gets a new one whose id is the hash of its smallest identifier, so the same
    input always yields the same id.
    """
    edges, nodes = identity_edges(identified)
    if identifiers is not None:
        if candidates is not None and "merged_into" in candidates.columns:
            identifiers = live_owners(identifiers, candidates)
        known = identifiers.select(
            node_key(F.col("scheme"), F.col("value")).alias("a"),
            F.concat(F.lit("C|"), F.col("candidate_id").cast("string")).alias("b"))
        edges, nodes = edges.unionByName(known), nodes.union(known.select("a"))
    labels, _ = connected_components(edges, nodes)
    labels = cut_lineage(labels)
    own = labels.where(F.col("node").startswith("I|"))
    fresh = own.groupBy("component").agg(F.sha2(F.min("node"), 256).alias("fresh_id"))
    if candidates is None:
        named = fresh.select("component", F.col("fresh_id").alias("candidate_id"))
        merged = labels.sparkSession.createDataFrame([], "loser string, winner string")
    else:
        members = (labels.where(F.col("node").startswith("C|"))
                   .select("component", F.expr("substring(node, 3)").alias("member"))
                   .join(candidates.select(F.col("id").cast("string").alias("member"), "cve_id",
                                           "first_seen_at"), "member")
                   .withColumnRenamed("member", "id"))
        winners = merge_winner(members)
        named = fresh.join(winners, "component", "left").select(
            "component", F.coalesce("winner", "fresh_id").alias("candidate_id"))
        merged = members.select("component", F.col("id").alias("loser")).join(
            winners, "component").where(
            F.col("loser") != F.col("winner")).select("loser", "winner")
    out = own.join(named, "component").select(
        F.regexp_extract("node", r"^I\|([^|]*)\|", 1).alias("scheme"),
        F.regexp_extract("node", r"(?s)^I\|[^|]*\|(.*)$", 1).alias("value"), "candidate_id")
    return out, merged


def candidate_cve(members: DataFrame, attached: DataFrame) -> DataFrame:
    """CVE per component: the winner's, else the first one attached.

    ``members`` has component, id, cve_id, first_seen_at; ``attached`` has component, cve,
    arrival, ordinal. ``cve_count`` above one reports a conflict that was kept visible.
    """
    own = members.groupBy("component").agg(F.min_by("cve_id", member_rank()).alias("own_cve"))
    first = attached.groupBy("component").agg(
        F.min_by("cve", F.struct("arrival", "ordinal")).alias("first_cve"),
        F.count_distinct("cve").alias("cve_count"))
    return own.join(first, "component", "full").select(
        "component", F.coalesce("own_cve", "first_cve").alias("cve_id"),
        F.coalesce("cve_count", F.lit(0)).alias("cve_count"))


FILL_COLUMNS = [
    "kev_date", "kev_source", "withdrawn", "severity_hint", "vuln_type", "attack_vector",
    "requires_auth", "requires_interaction", "affected_product", "affected_versions",
    "enrichment_confidence", "enrichment_method", "enrichment_updated_at",
]
STICKY_COLUMNS = ["in_kev", "has_public_poc"]
UNION_COLUMNS = ["cwe_ids", "reference_urls", "poc_urls"]


def merge_absorb(members: DataFrame) -> DataFrame:
    """One row per component: first known value by rank, and true-wins flags."""
    def first_known(name: str) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), member_rank())).alias(name)

    have = set(members.columns)
    return members.groupBy("component").agg(
        F.min_by("id", member_rank()).alias("winner"),
        *[first_known(c) for c in FILL_COLUMNS if c in have],
        *[F.max(c).alias(c) for c in STICKY_COLUMNS if c in have])


def merge_absorb_lists(members: DataFrame, column: str) -> DataFrame:
    """Ordered union of a list column in long form: component, value, position key.

    One row per distinct value keeps the union whole without gathering it in one task.
    """
    return (members.select("component", member_rank().alias("rank"),
                           F.posexplode(column).alias("pos", "value"))
            .groupBy("component", "value").agg(F.min(F.struct("rank", "pos")).alias("first_use")))


def merge_reassign(children: DataFrame, roots: DataFrame, key: list[str],
                   owner: str = "candidate_id") -> DataFrame:
    """Children under their root candidate; on equal keys the root's own row stays."""
    order = [F.desc(F.col(owner).eqNullSafe(F.col("root"))), F.col(owner)]
    moved = children.join(roots.select(F.col("id").alias(owner), "root"), owner, "left")
    moved = moved.withColumn("root", F.coalesce("root", owner))
    first = W.partitionBy("root", *key).orderBy(*order)
    return (moved.withColumn("rn", F.row_number().over(first)).where("rn = 1")
            .drop("rn", owner).withColumnRenamed("root", owner).select(*children.columns))
