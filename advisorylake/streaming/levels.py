"""Partial results of micro-batches in levels, so that readers open logarithmically many of them.

A micro-batch writes run (level 0, its number). When a batch completes a full group of FAN runs of a level, they are combined to
one run of the next level. A run counts only once its ``_SUCCESS`` file stands, so a job that is cut off leaves nothing that
a reader sees, and doing a batch again rewrites the same runs. The runs of a group are removed when the group one level
above is complete, which leaves running readers time to finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from advisorylake.operators.versioned import Files
from advisorylake.session import remove_path

#: Runs of a level that make one run of the next.
FAN = 4


class Levels:
    """Runs under ``path``. ``combine`` turns the rows of several runs (with the number of their first batch in ``batch``) into those of one."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, combine: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
        self.spark, self.path, self.combine, self.fan, self.files = spark, path.rstrip("/"), combine, fan, Files(spark)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _run(self, level: int, start: int) -> str:
        return f"{self.path}/level={level}/batch={start:012d}"

    def runs(self) -> list[tuple[int, int]]:
        """(first batch, level) of the fewest complete runs that hold every batch once, oldest first."""
        there: dict[int, int] = {}
        for folder in self.files.names(self.path):
            level = int(folder.split("=")[1])
            for name in self.files.names(f"{self.path}/{folder}"):
                start = int(name.split("=")[1])
                if level > there.get(start, -1) and "_SUCCESS" in self.files.names(self._run(level, start)):
                    there[start] = level
        out, at = [], 0
        for start in sorted(there):
            if start >= at:  # the runs inside one that was taken are older copies of its rows
                out.append((start, there[start]))
                at = start + self.fan ** there[start]
        return out

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("batch", LongType())])
        paths = [self._run(level, start) for start, level in runs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))

    def read(self) -> DataFrame:
        """The combined rows of all batches, as of the runs that are complete now."""
        return self.combine(self._read(self.runs()))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Run of a micro-batch, then the runs that it completes."""
        names = self.schema.names
        rows.select(*names).write.mode("overwrite").parquet(self._run(0, batch_id))
        level, size = 0, 1
        while (batch_id + 1) % (size * self.fan) == 0:
            start = batch_id + 1 - size * self.fan
            parts = [(start + i * size, level) for i in range(self.fan)]
            self.combine(self._read(parts)).select(*names).write.mode("overwrite").parquet(self._run(level + 1, start))
            if level:
                lower = size // self.fan
                for first, _ in parts:
                    for i in range(self.fan):
                        remove_path(self.spark, self._run(level - 1, first + i * lower))
            level, size = level + 1, size * self.fan
