"""Versioned tables against plain merges, what an upsert reads, conflicts, crashes and replays."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from advisorylake.operators import merge as M
from advisorylake.operators.versioned import BUCKET, Conflict, Journal, VersionedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def upsert_rule(old, changes):
    return M.merge(old, changes, ["k", "part"], {"v": M.new, "w": M.new_or_old})


def test_versions_equal_plain_merges(spark, tmp_path):
    schema = "k long, part string, v int, w int"
    target = spark.createDataFrame([(i if i % 9 else None, "a" if i % 3 else None, i, i) for i in range(200) if i % 9 or i == 0], schema)
    table = VersionedTable.create(target, f"{tmp_path}/t", ["k", "part"], 16)
    want = [rows(target)]
    for step in range(1, 4):
        changes = spark.createDataFrame([(i, "a" if i % 3 else None, -i, None if i % 2 else i) for i in range(150 * step, 150 * step + 90, step)], schema.replace("k long", "k int"))
        table.upsert(changes, upsert_rule)
        target = spark.createDataFrame(target.collect(), schema)
        target = upsert_rule(target, changes.withColumn("k", F.col("k").cast("long")))
        want.append(rows(target))
        assert rows(table.read()) == want[-1]
    assert [rows(table.read(version=v)) for v in range(1, 5)] == want
    table.vacuum()
    assert rows(table.read()) == want[-1] and len(table.files.names(f"{table.path}/manifests")) == 1


def test_small_batches_read_few_buckets(spark, tmp_path):
    numbers = spark.range(1_000_000).select(F.format_string("CVE-2024-%07d", "id").alias("id"), F.lit("PUBLISHED").alias("state"))
    table = VersionedTable.create(numbers, f"{tmp_path}/t", ["id"], 200, ["substring(id, 1, length(id) - 3)"])
    before = table.manifest()
    assert sum(before.rows.values()) == 1_000_000
    read = []

    def rule(old, changes):
        read.append(old)
        return M.merge(old, changes, ["id"], {"state": M.new})

    changes = spark.range(500_500, 501_500).select(F.format_string("CVE-2024-%07d", "id").alias("id"), F.lit("REJECTED").alias("state"))
    table.upsert(changes, rule)
    after = table.manifest()
    changed = {b for b in after.folders if after.folders[b] != before.folders[b]}
    files = {f.split(f"{BUCKET}=")[1].split("/")[0] for f in read[0].inputFiles()}
    assert files == changed and sum(before.rows[b] for b in changed) < 50_000
    assert table.read().where("state = 'REJECTED'").count() == 1000 and sum(after.rows.values()) == 1_000_000


def test_deletes_empty_buckets_and_empty_tables(spark, tmp_path):
    schema = "cve_id string, cwe_id string"
    table = VersionedTable.create(spark.createDataFrame([], schema), f"{tmp_path}/t", ["cve_id", "cwe_id"], 4, ["cve_id"])
    assert table.read().count() == 0
    replace = lambda old, new: M.replace_children(old, new.where("cwe_id IS NOT NULL"), new)
    table.upsert(spark.createDataFrame([("C1", "W1"), ("C1", "W2"), ("C2", "W3"), (None, None)], schema), replace)
    table.upsert(spark.createDataFrame([("C1", None), ("C2", "W4")], schema), replace)
    assert rows(table.read()) == [("C2", "W4")] and len(table.manifest().folders) == 1
    table.upsert(spark.createDataFrame([], schema), replace)
    assert rows(table.read()) == [("C2", "W4")]
    with pytest.raises(Conflict):
        VersionedTable.create(spark.createDataFrame([], schema), f"{tmp_path}/t", ["cve_id"], 4)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    schema = "k long, part string, v int, w int"
    table = VersionedTable.create(spark.createDataFrame([(1, "a", 1, 1)], schema), f"{tmp_path}/t", ["k", "part"], 4)
    one, two = (table.stage(spark.createDataFrame([(1, "a", v, v)], schema), upsert_rule) for v in (2, 3))
    table.publish(two)
    with pytest.raises(Conflict):
        table.publish(one)
    assert rows(table.read()) == [(1, "a", 3, 3)]


def test_rows_that_leave_their_bucket_are_refused(spark, tmp_path):
    frame = spark.createDataFrame([(i, i) for i in range(50)], "k long, v long")
    table = VersionedTable.create(frame, f"{tmp_path}/t", ["k"], 16)
    with pytest.raises(ValueError, match="buckets"):
        table.upsert(frame.where("k = 1"), lambda old, new: old.unionByName(spark.range(100).selectExpr("id AS k", "id AS v")))
    assert rows(table.read()) == rows(frame)


def test_a_batch_is_applied_once(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1)], "k long, v long")
    table = VersionedTable.create(frame, f"{tmp_path}/t", ["k"], 4)
    add = lambda old, new: M.merge(old, new, ["k"], {"v": lambda a, b: a + b})
    for batch in (0, 0, 1, 0, 1):
        table.upsert(frame, add, "feed", batch)
    assert rows(table.read()) == [(1, 3)]


@pytest.mark.parametrize("published", [0, 1, 2])
def test_a_crash_between_tables_is_completed(spark, tmp_path, monkeypatch, published):
    """The journal entry is in place and some tables are not: the next start publishes the rest, a replay changes nothing."""
    frame = spark.createDataFrame([(1, 1)], "k long, v long")
    tables = {n: VersionedTable.create(frame, f"{tmp_path}/{n}", ["k"], 4) for n in ("a", "b")}
    add = lambda old, new: M.merge(old, new, ["k"], {"v": lambda a, b: a + b})
    journal = Journal(spark, f"{tmp_path}/journal", tables)

    def run(batch):
        journal.recover()
        if journal.last() < batch:
            journal.commit(batch, {n: t.stage(frame, add) for n, t in tables.items()})

    move, moved = journal.files.move, []

    def failing(source, to):
        if "/manifests/" in to:
            moved.append(to)
            if len(moved) > published:
                raise OSError("lost")
        move(source, to)

    monkeypatch.setattr(journal.files, "move", failing)
    if published < 2:
        with pytest.raises(OSError):
            run(0)
    else:
        run(0)
    monkeypatch.undo()
    assert [rows(t.read()) for t in tables.values()] == [[(1, 2 if i < published else 1)] for i in range(2)]
    run(0)
    assert [rows(t.read()) for t in tables.values()] == [[(1, 2)], [(1, 2)]]
    run(1)
    assert [rows(t.read()) for t in tables.values()] == [[(1, 3)], [(1, 3)]]
