"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``; a local one is set up only where that
setting is absent and the session runs on one machine (tests).  Tables go when the driver's process
ends (``sources.scratch.sweep`` removes them earlier).  Every cut of lineage is a written Parquet table, so
a lost executor costs at most the tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import remove, scratch_folder, settle

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """One run's intermediate tables; ``put`` writes and rereads, ``drop`` frees the disk early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_folder(spark, name)
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str, compression: str = "snappy", partition: str | None = None) -> DataFrame:
        """``df`` written and reread; its shuffles' files go when it is written, as nothing reads them again."""
        at = self.path(name)
        conf = self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            writer = df.write.option("compression", compression)
            (writer.partitionBy(partition) if partition else writer).parquet(at)
        finally:
            conf.set(_CLEANUP, before)
        settle(self.spark)
        columns = [f for f in df.schema.fields if f.name != partition] + [f for f in df.schema.fields if f.name == partition]
        out = self.spark.read.schema(T.StructType(columns)).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for f in frames:
            self.remove(f._scratch_path)

    def remove(self, path: str) -> None:
        remove(self.spark, path)


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row whole, as a struct ``row``, beside some columns; so names of the table's own columns can't clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpack_row(df: DataFrame, like: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``like`` from ``row``, some of them replaced, in their old types."""
    out = []
    for f in like.schema.fields:
        c = replaced[f.name].cast(f.dataType) if f.name in replaced else F.col("row").getField(f.name)
        out.append(c.alias(f.name))
    return df.select(*out)
