"""The prefix trie of conversations, from union-find over the common prefixes of sorted neighbours.

Distinct sequences of turns are range-sorted. The edges of a partition join neighbours and weigh what the two have in common.
Taken in descending depth, each edge that merges two components creates or extends the branching node at its depth; the turns
between two branching nodes are a chain of nodes with the same members. Nodes that a neighbouring partition has too, the
prefixes across its borders, stay open. Open nodes are contracted to one chain for each border, the totals of the chains
flow up the tree of borders, and suffix sums along a chain complete its nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from advisorylake.session import Scratch

#: Turns of distinct sequences that a partition is meant to hold.
PART_TURNS = 200_000
#: Ids joined to one piece of text before they are hashed.
PIECE_IDS = 50_000

_NODE = ("part int, owner int, depth bigint, least bigint, parent_least bigint, parent_owner int, n bigint, kids bigint, "
         "leaves bigint, saved bigint, words bigint, sid string")
_NAMES = [f.split()[0] for f in _NODE.split(", ")]


def turn_sequences(conversations: DataFrame, share: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): digests and word counts of each rebuilt conversation's turns.

    Turns stand in the order of ``turn`` (null first, then by digest); null roles and texts are empty. A conversation c starts
    with the first crc32(c) % ``most`` turns of conversation c - c % ``share`` (all if it has fewer, none if it is absent), and
    its own turns follow after as many of them. Rows with a null conv_id are left out, equal rows are turns of their own.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turn = F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy(
        "conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own"))
    opening = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("opening"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    return own.withColumn("base", F.col("conv_id") - F.col("conv_id") % share).join(opening, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("opening", F.slice("own", 1, 0)), F.lit(1), h.cast("int")),
                            F.slice("own", (h + 1).cast("int"), F.greatest(F.size("own") - h, F.lit(0)).cast("int"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Elements that two arrays begin with alike."""
    place = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(place == 0, F.size(a)).otherwise(place - 1).cast("long")


class Borders:
    """Chains of the nodes that partitions share; border b lies between the b-th partition and the next.

    ``across[b]`` turns are common to both sides of border b, and ``inside[p]`` to the first and last sequence of a
    partition. Of the nodes on the path of border b those deeper than ``fork[b]`` are first met there: they are chain b.
    """

    def __init__(self, inside: list[int], across: list[int]) -> None:
        self.across, self.fork, self.parent, self.paths = across, [], [], []
        path: list[tuple[int, int]] = []  # (chain, its last depth on the path), from the root down
        for b, depth in enumerate(across):
            fork = min(across[b - 1], inside[b], depth) if b else -1
            while path and path[-1][1] > fork:
                chain, _ = path.pop()
                if fork > (path[-1][1] if path else -1):
                    path.append((chain, fork))
                    break
            self.fork.append(fork)
            self.parent.append(path[-1][0] if path else None)
            if depth > fork:
                path.append((b, depth))
            self.paths.append(list(path))

    def side(self, b: int) -> tuple[int, list[int], list[int]]:
        """Depth up to which the nodes at a border are open, and their chains with the last depth of each."""
        if not 0 <= b < len(self.across):
            return -1, [], []
        return self.across[b], [c for c, _ in self.paths[b]], [d for _, d in self.paths[b]]

    def flow(self, totals: dict[int, tuple], add) -> list[tuple]:
        """(chain, depth, total, number of chains) for the nodes where other chains fork off, from each chain's own total."""
        totals, into = dict(totals), {}
        for b in range(len(self.across) - 1, 0, -1):
            if self.across[b] > self.fork[b]:
                up, at = self.parent[b], (self.parent[b], self.fork[b])
                into[at] = (add(into[at][0], totals[b]), into[at][1] + 1) if at in into else (totals[b], 1)
                totals[up] = add(totals[up], totals[b])
        return [(*at, total, n) for at, (total, n) in sorted(into.items())]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column, and their values one after another."""
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()


class Forest:
    """Components of the sorted sequences of one partition, and the node each stands on."""

    def __init__(self, table: pa.Table, left: tuple, right: tuple) -> None:
        self.left, self.right = left, right
        self.lengths, digests = _flat(table.column("digests"))
        _, words = _flat(table.column("words"))
        ends = np.frombuffer(digests.buffers()[1], np.int32)[digests.offset:digests.offset + len(digests) + 1] if len(digests) else [0, 0]
        raw = digests.buffers()[2] if len(digests) else b""
        self.turns = np.frombuffer(memoryview(raw)[ends[0]:ends[-1]], np.uint64).reshape(-1, 2)
        self.words = np.append(words.to_numpy(zero_copy_only=False).astype(np.int64), 0)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.upto = np.concatenate([[0], np.cumsum(self.words)])  # words before each turn of the partition
        n = table.num_rows
        self.depth, self.n, self.least = self.lengths.tolist(), table.column("n").to_pylist(), table.column("least").to_pylist()
        self.kids, self.leaves, self.saved = [0] * n, [0] * n, [0] * n
        self.first, self.last, self.rep, self.term = list(range(n)), list(range(n)), list(range(n)), list(range(n))
        self.low, self.up, self.same = [None] * n, [-1] * n, list(range(n))
        self._merge()

    def neighbours(self) -> np.ndarray:
        """Turns in common of each two neighbouring sequences."""
        m = np.minimum(self.lengths[:-1], self.lengths[1:])
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        a, b = (self.turns[np.repeat(x, m) + nth] for x in (self.begins[:-1], self.begins[1:]))
        differs = np.where((a == b).all(axis=1), np.iinfo(np.int64).max, nth)
        out = m.copy()
        some = np.flatnonzero(m)
        if len(some):
            out[some] = np.minimum(m[some], np.minimum.reduceat(differs, (np.cumsum(m) - m)[some]))
        return out

    def _sum(self, node: int, low: int) -> int:
        """Words of a node's turns below depth ``low``."""
        start = self.begins[self.rep[node]]
        return int(self.upto[start + self.depth[node]] - self.upto[start + low])

    def open_to(self, node: int) -> int:
        """Greatest depth at which the nodes over this one are shared with another partition."""
        return max(self.left[0] if self.first[node] == 0 else -1, self.right[0] if self.last[node] == len(self.lengths) - 1 else -1)

    def owner(self, node: int, depth: int) -> int:
        side = self.right if self.last[node] == len(self.lengths) - 1 and depth <= self.right[0] else self.left
        return side[1][bisect_left(side[2], depth)]

    def _merge(self) -> None:
        common = self.neighbours()
        root, node_of = list(range(len(self.lengths))), list(range(len(self.lengths)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for e in np.argsort(-common, kind="stable").tolist():
            depth, a, b = int(common[e]), find(e), find(e + 1)
            x, y = node_of[a], node_of[b]
            first, last = self.first[x], self.last[y]
            if self.depth[x] == depth:
                to = x
                if self.depth[y] == depth:
                    self._absorb(x, y)
                else:
                    self._hang(y, depth, to)
            elif self.depth[y] == depth:
                to = y
                self._hang(x, depth, to)
            else:
                to = self._new(depth, self.rep[x])
                self._hang(x, depth, to)
                self._hang(y, depth, to)
            self.first[to], self.last[to] = first, last
            root[b], node_of[a] = a, to
        if len(self.lengths):
            self._hang(node_of[find(0)], -1, -1)

    def _new(self, depth: int, rep: int) -> int:
        for values, v in ((self.depth, depth), (self.n, 0), (self.least, None), (self.kids, 0), (self.leaves, 0), (self.saved, 0), (self.first, 0),
                          (self.last, 0), (self.rep, rep), (self.term, -1), (self.low, None), (self.up, -1), (self.same, len(self.same))):
            values.append(v)
        return len(self.depth) - 1

    def _give(self, to: int, n: int, least: int | None, kids: int, leaves: int, saved: int) -> None:
        self.n[to] += n
        self.least[to] = min((v for v in (self.least[to], least) if v is not None), default=None)
        self.kids[to] += kids
        self.leaves[to] += leaves
        self.saved[to] += saved

    def _absorb(self, x: int, y: int) -> None:
        """Two components that stand on the same node."""
        self._give(x, self.n[y], self.least[y], self.kids[y], self.leaves[y], self.saved[y])
        self.term[x] = max(self.term[x], self.term[y])
        self.same[y] = x

    def _hang(self, node: int, low: int, to: int) -> None:
        """Close the chain above a node: it covers the depths from ``low`` + 1 to the node's own."""
        self.low[node], self.up[node] = low, to
        if self.open_to(node) <= low and to >= 0:
            self._give(to, self.n[node], self.least[node], 1, self.leaves_of(node), self.saved[node] + (self.n[node] - 1) * self._sum(node, low))

    def leaves_of(self, node: int) -> int:
        return self.leaves[node] or int(self.kids[node] == 0)

    def node(self, i: int) -> int:
        while self.same[i] != i:
            i = self.same[i]
        return i

    def rows(self, part: int, sids: list[str]) -> pa.Table:
        chains = [c for c in range(len(self.depth)) if self.low[c] is not None and self.same[c] == c]
        out = {name: [] for name in _NAMES}

        def open_row(node: int, depth: int, *values) -> None:
            word = self.words[self.begins[self.rep[node]] + depth - 1] if depth else 0
            for name, v in zip(_NAMES, (part, self.owner(node, depth), depth, values[1], None, None, *values[:1], *values[2:5], int(word), values[5])):
                out[name].append(v)

        closed, top_parent, top_owner = [], [], []
        for c in chains:
            low, depth, limit = self.low[c], self.depth[c], self.open_to(c)
            for d in range(low + 1, min(limit, depth) + 1):
                if d == depth:
                    open_row(c, d, self.n[c], self.least[c], self.kids[c], self.leaves[c], self.saved[c], sids[self.term[c]] if self.term[c] >= 0 else None)
                elif d == limit:
                    open_row(c, d, self.n[c], self.least[c], 1, self.leaves_of(c), self.saved[c] + (self.n[c] - 1) * self._sum(c, d), None)
                else:
                    open_row(c, d, 0, None, 0, 0, 0, None)
            above = max(low, limit)
            if depth > above:
                closed.append(c)
                up = self.node(self.up[c]) if self.up[c] >= 0 else -1
                if limit > low:
                    parent = None, self.owner(c, limit)
                elif up < 0:
                    parent = None, None
                elif self.open_to(up) >= low:
                    parent = None, self.owner(up, low)
                else:
                    parent = self.least[up], None
                top_parent.append(parent[0])
                top_owner.append(parent[1])
        of = lambda values: np.array([values[c] for c in closed], np.int64)
        depth, n, rep = of(self.depth), of(self.n), of(self.rep)
        above = np.array([max(self.low[c], self.open_to(c)) for c in closed], np.int64)
        size = depth - above
        k = np.repeat(np.arange(len(closed)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + above[k] + 1
        start, bottom, top = self.begins[rep][k], at == depth[k], at == above[k] + 1
        saved = of(self.saved)[k] + (n[k] - 1) * (self.upto[start + depth[k]] - self.upto[start + np.maximum(at - 1, 0)])
        least = pa.array(of(self.least))
        whole = np.arange(len(closed))
        ended = pa.array([sids[self.term[c]] if self.term[c] >= 0 else None for c in closed], pa.string())
        some = lambda values, kind, mask: pa.array(values, kind).take(pa.array(k, mask=~mask))
        parents = pc.if_else(pa.array(top), pa.array(top_parent, pa.int64()).take(pa.array(k)), least.take(pa.array(k)))
        done = pa.table([
            pa.array(np.full(len(k), part), pa.int32()), pa.nulls(len(k), pa.int32()), pa.array(at), least.take(pa.array(k)), parents,
            some(top_owner, pa.int32(), top), pa.array(n[k]), pa.array(np.where(bottom, of(self.kids)[k], 1)),
            pa.array(np.array([self.leaves_of(c) for c in closed], np.int64)[k]), pa.array(saved),
            pa.array(np.where(at > 0, self.words[start + np.maximum(at - 1, 0)], 0)), ended.take(pa.array(whole[k], mask=~bottom))], names=_NAMES)
        kinds = done.schema
        return pa.concat_tables([done, pa.table([pa.array(out[f.name], f.type) for f in kinds], names=_NAMES)])


def _forest(key: tuple, table: pa.Table, sides: Broadcast) -> pa.Table:
    part = key[0].as_py()
    table = table.sort_by("place")
    return Forest(table, *sides.value[part]).rows(part, table.column("sid").to_pylist())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sid, conv_id) rows as pieces of comma-joined ids."""
    for batch in batches:
        sids, ids, rows = batch.column("sid").to_pylist(), batch.column("conv_id").to_pylist(), []
        for sid, run in groupby(range(len(sids)), sids.__getitem__):
            run = list(run)
            for i in range(0, len(run), PIECE_IDS):
                some = [ids[j] for j in run[i:i + PIECE_IDS]]
                rows.append((sid, some[0], ",".join(map(str, some))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.string()))],
                                         ["sid", "start", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each sid over its pieces, which come in order; only the running hash is held."""
    now, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()], pa.string())], ["sid", "ends_sha256"])
    for batch in batches:
        for sid, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
            if sid == now:
                state.update(b"," + ids.encode())
            else:
                if state:
                    yield done()
                now, state = sid, hashlib.sha256(ids.encode())
    if state:
        yield done()


def id_hashes(members: DataFrame, parts: int) -> DataFrame:
    """(sid, ends_sha256): SHA-256 of the ascending ids of each sid, comma-joined.

    The ids are sorted by ranges of (sid, id), so that a sid with a third of all ids is spread out, and joined to pieces;
    only the hash itself runs over the pieces of a sid one after another.
    """
    order = ["sid", "conv_id"]
    pieces = members.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "sid string, start bigint, ids string")
    return pieces.repartition("sid").sortWithinPartitions("sid", "start").mapInArrow(_hashes, "sid string, ends_sha256 string")


def _complete(scratch: Scratch, shared: DataFrame, borders: Borders) -> DataFrame:
    """The open nodes with what lies below them on their chain and on the chains that fork off it."""
    spark = shared.sparkSession
    merged = scratch.write(shared.groupBy("owner", "depth").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("words").alias("words"), F.max("sid").alias("sid")), "merged")
    below = W.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Frames from the driver have one row for each border at most.
    small = lambda rows, kinds: F.broadcast(spark.createDataFrame(rows, f"owner int, depth bigint, {kinds}"))

    sums = {r["owner"]: (r["n"], r["least"], r["leaves"]) for r in merged.groupBy("owner").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("leaves").alias("leaves")).collect()}
    least = lambda a, b: min((v for v in (a, b) if v is not None), default=None)
    into = borders.flow(sums, lambda a, b: (a[0] + b[0], least(a[1], b[1]), a[2] + b[2]))
    came = small([(o, d, *t, k) for o, d, t, k in into], "n_in bigint, least_in bigint, leaves_in bigint, kids_in bigint")
    plus = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    counted = scratch.write(merged.join(came, ["owner", "depth"], "left").select(
        "owner", "depth", "words", "sid", "saved", F.sum(plus("n", "n_in")).over(below).alias("n"),
        F.min(F.least("least", "least_in")).over(below).alias("least"), F.sum(plus("leaves", "leaves_in")).over(below).alias("leaves"),
        (plus("kids", "kids_in") + F.when(F.row_number().over(W.partitionBy("owner").orderBy(F.desc("depth"))) > 1, 1).otherwise(0)).alias("kids")), "counted")

    worth = F.col("saved") + (F.col("n") - 1) * F.col("words")
    sums = {r["owner"]: r["s"] for r in counted.groupBy("owner").agg(F.sum(worth).alias("s")).collect()}
    came = small([(o, d, t) for o, d, t, _ in borders.flow(sums, lambda a, b: a + b)], "saved_in bigint")
    tops = [(b, borders.fork[b] + 1, borders.parent[b], borders.fork[b]) for b in range(1, len(borders.across)) if borders.across[b] > borders.fork[b]]
    full = scratch.write(counted.join(came, ["owner", "depth"], "left").select(
        "owner", "depth", "sid", "n", "least", "leaves", "kids", F.sum(worth + F.coalesce("saved_in", F.lit(0))).over(below).alias("saved"),
        F.lead("least").over(W.partitionBy("owner").orderBy(F.desc("depth"))).alias("chain_parent")), "full")
    forks = small(tops, "p_owner int, p_depth bigint").join(
        full.select(F.col("owner").alias("p_owner"), F.col("depth").alias("p_depth"), F.col("least").alias("fork_parent")), ["p_owner", "p_depth"])
    return scratch.write(full.join(F.broadcast(forks.select("owner", "depth", "fork_parent")), ["owner", "depth"], "left").withColumn(
        "parent_least", F.coalesce("chain_parent", "fork_parent")), "open")


def prefix_trie(sequences: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Every node of the prefix trie of (conv_id, turns: array<struct<digest, words>>), root included.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (nodes without children
    below or at it), saved_tokens (sum over its subtree of (n_convs - 1) * words) and ends_sha256 (of the ids of the
    conversations that end there, ascending and comma-joined).

    Ids are distinct whole numbers. Equal sequences become one with a count, so a group of copies of any size is one row of
    the sort; sequences without turns are members of the root. No rows give no nodes. A conversation is held whole as 16 bytes a turn,
    and a partition as ``part_turns`` turns of distinct conversations.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark, "trie")
    digests = F.transform("turns", lambda t: t["digest"])
    sid = F.sha2(F.array_join(F.transform(digests, lambda d: F.hex(d)), ""), 256)
    named = scratch.write(sequences.select("conv_id", sid.alias("sid"), digests.alias("digests"), F.transform("turns", lambda t: t["words"]).alias("words")), "named")
    distinct = scratch.write(named.groupBy("sid").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("digests").alias("digests"), F.first("words").alias("words")), "distinct")
    turns = distinct.agg(F.sum(F.size("digests"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // part_turns))
    ordered = scratch.write(distinct.repartitionByRange(parts, "digests").sortWithinPartitions("digests").withColumn(
        "place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33).cast("int")), "ordered")

    ends = scratch.write(ordered.groupBy("part").agg(
        F.min_by("digests", "place").alias("head"), F.max_by("digests", "place").alias("tail")), "ends")
    there = sorted(r[0] for r in ends.select("part").collect())  # one row for each partition, here and below
    follows = spark.createDataFrame(list(zip(there, there[1:])), "part int, next int")
    inside = dict(tuple(r) for r in ends.select("part", common_prefix(F.col("head"), F.col("tail"))).collect())
    across = dict(tuple(r) for r in ends.select("part", "tail").join(F.broadcast(follows), "part").join(
        ends.select(F.col("part").alias("next"), "head"), "next").select("part", common_prefix(F.col("tail"), F.col("head"))).collect())
    borders = Borders([inside[p] for p in there], [across[p] for p in there[:-1]])
    sides = spark.sparkContext.broadcast({p: (borders.side(i - 1), borders.side(i)) for i, p in enumerate(there)})

    forest = scratch.write(ordered.groupBy("part").applyInArrow(lambda key, table: _forest(key, table, sides), _NODE), "forest")
    shared = forest.where("owner IS NOT NULL")
    full = _complete(scratch, shared, borders)
    closed = forest.where("owner IS NULL")
    columns = ["least", "depth", "parent_least", "n", "kids", "leaves", "saved", "sid"]
    seen = shared.select("part", "owner", "depth").distinct().join(
        full.select("owner", "depth", F.col("least").alias("found")), ["owner", "depth"]).select(
        "part", F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), "found")
    under = closed.where("parent_owner IS NOT NULL").join(seen, ["part", "parent_owner", "depth"]).withColumn("parent_least", F.col("found"))
    nodes = scratch.write(closed.where("parent_owner IS NULL").select(*columns).unionByName(under.select(*columns)).unionByName(full.select(*columns)), "nodes")
    hashes = id_hashes(named, parts)
    none = F.lit(hashlib.sha256(b"").hexdigest()).alias("ends_sha256")
    out = nodes.where("sid IS NULL").select(*columns, none).unionByName(nodes.join(hashes, "sid").select(*columns, "ends_sha256"))
    scratch.keep_only(nodes, named)
    return out.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
