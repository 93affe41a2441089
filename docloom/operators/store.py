"""A directory of Parquet tables, replaced table by table as snapshots."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docloom.functions import schema


_CLEANED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, this application's own part of it.

    Where the session names none, a local one gets a temporary folder; a
    cluster has none that all nodes see, so that is an error.  What is in it
    goes when the driver ends.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    own = held.get()
    if own not in _CLEANED:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _CLEANED.add(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Store:
    """Tables under a path.  A table is the newest of its snapshot folders, so a reader never sees half a write."""

    spark: SparkSession
    path: str

    @classmethod
    def default(cls, spark: SparkSession) -> "Store":
        path = spark.conf.get("docloom.store", None)
        if path is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set docloom.store to a folder that all nodes share")
        return cls(spark, path or os.path.join(os.getcwd(), "docloom-store"))

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _snapshots(self, table: str) -> list[str]:
        fs, path = self._fs()
        folder = path(f"{self.path}/{table}")
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        done = [p.getName() for p in names if fs.exists(path(p, "_SUCCESS"))]
        return sorted(done)

    def read(self, table: str) -> DataFrame:
        """The table, with columns that it lacks added; empty if it was never written."""
        found = self._snapshots(table)
        if not found:
            return schema.empty(self.spark, table)
        return schema.conform(self.spark.read.parquet(f"{self.path}/{table}/{found[-1]}"), table)

    def write(self, table: str, rows: DataFrame, keep: int = 2) -> None:
        """A new snapshot; older ones but for the last few are deleted."""
        found = self._snapshots(table)
        number = int(found[-1].split("-")[0]) + 1 if found else 0
        if "term" in rows.columns:
            # Sorted by term, so that a query's terms are found by the files' statistics.
            rows = rows.repartitionByRange("term").sortWithinPartitions("term")
        rows.write.parquet(f"{self.path}/{table}/{number:010d}-{uuid.uuid4().hex[:8]}")
        fs, path = self._fs()
        for old in found[: max(0, len(found) + 1 - keep)]:
            fs.delete(path(f"{self.path}/{table}/{old}"), True)
