"""Keyed tables in hash buckets: an upsert reads and rewrites only the buckets that its changes fall into.

A version of a table is one manifest file, which names the folder that holds each bucket. Data files are written
first and never change; the manifest of the next version is put in place by a rename that fails if
the version exists. So readers see a version or the next, a failed job leaves files that nothing names, and of two
concurrent writers one is told to start again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from advisorylake.session import Scratch, remove_path

#: Partition column of the data folders.
BUCKET = "on_bucket"


class Conflict(RuntimeError):
    """Another writer published this version first."""


class Files:
    """Small text files in any store that Spark reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.conf), target

    def names(self, path: str) -> list[str]:
        fs, target = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def read(self, path: str) -> str:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, target = self._at(path)
        stream = fs.create(target, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, source: str, to: str) -> None:
        """Rename; raises :class:`Conflict` if ``to`` exists."""
        _, a = self._at(source)
        fs, b = self._at(to)
        fs.mkdirs(b.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(fs.makeQualified(a), fs.makeQualified(b), options)
        except Exception as error:  # noqa: BLE001 - py4j wraps what Java throws
            if "FileAlreadyExists" in str(error):
                raise Conflict(to) from None
            raise

    def publish(self, path: str, text: str) -> None:
        """Write beside the target, then move into place."""
        beside = f"{path}.{uuid.uuid4().hex}.new"
        self.write(beside, text)
        self.move(beside, path)


@dataclass(frozen=True)
class Manifest:
    """One version: the schema, how keys are dealt to buckets, and where each bucket's rows are."""

    version: int
    schema: str
    key: list[str]
    cluster: list[str]
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    #: Last batch of each writer that this version holds.
    batches: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Pending:
    """A next version whose files are written and which no reader sees yet."""

    manifest: Manifest
    staged: str
    touched: list[int]


class VersionedTable:
    """A table under ``path``. Rows of equal ``cluster`` values share a bucket; they must follow from the key.

    A coarse ``cluster`` (the thousands of a running number, a date) keeps rows that change together in few buckets. Without
    such locality a batch touches at most as many buckets as it has changes, so a bucket is best one file
    of 100 to 200 MB.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    @classmethod
    def create(cls, df: DataFrame, path: str, key: list[str], buckets: int, cluster: list[str] | None = None) -> VersionedTable:
        """A new table with the rows of ``df`` as version 1; raises :class:`Conflict` where one exists."""
        table = cls(df.sparkSession, path)
        if BUCKET in df.columns:
            raise ValueError(f"a column is named {BUCKET}")
        if table.files.names(f"{table.path}/manifests"):
            raise Conflict(path)
        empty = Manifest(0, df.schema.json(), key, cluster or [f"`{k}`" for k in key], buckets)
        table.publish(table._write(df, empty, None, {}))
        return table

    def manifest(self, version: int | None = None) -> Manifest:
        names = [n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]
        name = names[-1] if version is None else f"{version:012d}.json"
        return Manifest(**json.loads(self.files.read(f"{self.path}/manifests/{name}")))

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows of a version (the last one), or those of some buckets."""
        return self._read(self.manifest(version), buckets)

    def _read(self, m: Manifest, buckets: Iterable[int] | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        wanted = m.folders if buckets is None else {str(b): m.folders[str(b)] for b in buckets if str(b) in m.folders}
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose columns equal a row of ``keys``, which has the columns that ``cluster`` needs; only their buckets are read."""
        m = self.manifest()
        wanted = self._typed(keys, m).distinct()
        touched = [r[0] for r in wanted.select(self.bucket(m)).distinct().collect()]  # no more than there are buckets
        return self._read(m, touched).join(wanted, keys.columns, "left_semi")

    @staticmethod
    def bucket(m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*map(F.expr, m.cluster)), F.lit(m.buckets)).cast("int")

    def _typed(self, df: DataFrame, m: Manifest) -> DataFrame:
        """``df`` with key columns of the table's types, since a hash depends on the type."""
        kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(m.schema))}
        return df.withColumns({k: F.col(k).cast(kinds[k]) for k in m.key if k in df.columns})

    def _write(self, rows: DataFrame, m: Manifest, touched: list[int] | None, batches: dict[str, int]) -> Pending:
        """Rows of the touched buckets (None: of all) in a new folder, and the manifest that names it."""
        schema = StructType.fromJson(json.loads(m.schema))
        folder = f"{m.version + 1:012d}-{uuid.uuid4().hex}"
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).withColumn(BUCKET, self.bucket(m))
        out.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        try:
            written = self.spark.read.parquet(f"{self.path}/data/{folder}").groupBy(BUCKET).count().collect()  # one row a bucket
        except PySparkException as error:  # no rows leave no files and no schema
            if "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            written = []
        count = {int(r[0]): r[1] for r in written}
        if touched is not None and not set(count) <= set(touched):
            raise ValueError("the changed rows belong to buckets that the changes did not name; cluster by columns that the rule keeps")
        folders, sizes = dict(m.folders), dict(m.rows)
        for b in count if touched is None else touched:
            folders.pop(str(b), None)
            sizes.pop(str(b), None)
            if b in count:
                folders[str(b)], sizes[str(b)] = folder, count[b]
        done = replace(m, version=m.version + 1, folders=folders, rows=sizes, batches={**m.batches, **batches})
        staged = f"{self.path}/staged/{done.version:012d}-{uuid.uuid4().hex}.json"
        self.files.write(staged, json.dumps(asdict(done)))
        return Pending(done, staged, sorted(count) if touched is None else touched)

    def stage(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], writer: str | None = None,
              batch: int | None = None) -> Pending | None:
        """The next version with ``apply(rows of the touched buckets, changes)`` in their place.

        ``changes`` has the columns that ``cluster`` needs. With a writer, batches are numbered in ascending order, and one that
        the table holds already gives None.
        """
        m = self.manifest()
        if writer is not None and m.batches.get(writer, -1) >= batch:
            return None
        scratch = Scratch(self.spark, "changes")
        kept = scratch.write(self._typed(changes, m), "changes")
        touched = sorted(r[0] for r in kept.select(self.bucket(m)).distinct().collect())  # no more than there are buckets
        pending = self._write(apply(self._read(m, touched), kept), m, touched, {} if writer is None else {writer: batch})
        scratch.keep_only()
        return pending

    def publish(self, pending: Pending) -> None:
        self.files.move(pending.staged, f"{self.path}/manifests/{pending.manifest.version:012d}.json")

    def upsert(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], writer: str | None = None,
               batch: int | None = None) -> VersionedTable:
        """Stage and publish; a batch that was applied before changes nothing."""
        pending = self.stage(changes, apply, writer, batch)
        if pending is not None:
            self.publish(pending)
        return self

    def vacuum(self, versions: int = 1) -> None:
        """Forget all but the last ``versions`` versions and remove the files that none of them names.

        Not to be run while a writer is at work or a reader uses an older version.
        """
        names = [n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]
        used = {f for n in names[-versions:] for f in Manifest(**json.loads(self.files.read(f"{self.path}/manifests/{n}"))).folders.values()}
        for name in names[:-versions]:
            remove_path(self.spark, f"{self.path}/manifests/{name}")
        for folder in self.files.names(f"{self.path}/data"):
            if folder not in used:
                remove_path(self.spark, f"{self.path}/data/{folder}")


class Journal:
    """Batches that change several tables at once.

    A batch is committed by one file that names the staged version of every table it changes. Publishing them afterwards can be
    cut off between any two; :meth:`recover` completes it, and every batch starts with that. A batch that the journal holds
    is never applied again, so a replay changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, VersionedTable]) -> None:
        self.path, self.tables, self.files = path.rstrip("/"), tables, Files(spark)

    def entries(self) -> list[str]:
        return [n for n in self.files.names(self.path) if n.endswith(".json")]

    def last(self) -> int:
        """Number of the last committed batch, -1 before the first."""
        names = self.entries()
        return int(names[-1][:-5]) if names else -1

    def recover(self) -> None:
        names = self.entries()
        if not names:
            return
        for name, (staged, version) in json.loads(self.files.read(f"{self.path}/{names[-1]}")).items():
            table = self.tables[name]
            if f"{version:012d}.json" not in self.files.names(f"{table.path}/manifests"):
                self.files.move(staged, f"{table.path}/manifests/{version:012d}.json")

    def commit(self, batch: int, pending: dict[str, Pending]) -> None:
        for name, p in pending.items():
            if self.tables[name].manifest().version + 1 != p.manifest.version:
                raise Conflict(name)
        self.files.publish(f"{self.path}/{batch:012d}.json", json.dumps({n: [p.staged, p.manifest.version] for n, p in pending.items()}))
        self.recover()
