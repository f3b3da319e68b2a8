"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "advisorylake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    pin_utc(spark)
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Calendar functions follow the session zone; every rule here is written in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there the driver and the
    executors are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-advisorylake-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one job in the shared folder, removed as soon as nothing reads them.

    A table written here cuts the lineage: a lost executor costs the tasks it ran, which
    re-read files, and never an earlier step of the job.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.paths = spark, scratch_path(spark, label), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.mode("error").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = True
        return out

    def keep_only(self, *kept: DataFrame) -> None:
        """Delete every table written here that none of ``kept`` reads."""
        read = [f for df in kept for f in df.inputFiles()]
        for path in [p for p, there in self.paths.items() if there]:
            folder = path.rsplit("/", 1)[-1]
            if not any(f"/{folder}/" in f for f in read):
                remove_path(self.spark, path)
                self.paths[path] = False


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Files survive the loss of an executor, so a lost task re-reads them instead of
    replaying every earlier round of an iteration.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
