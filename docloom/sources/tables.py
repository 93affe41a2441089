"""Reading tables of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Up to this size a table may sit in one row group, which one task would read alone.
SMALL_BYTES = 64 << 20
TASK_BYTES = 128 << 20


def read(spark: SparkSession, folder: str, name: str, weight: int = 1) -> DataFrame:
    """A table; a small one in fewer files than cores is dealt out to all of them, any other is left where it lies.

    The size is the planner's estimate from the files, so nothing is read to
    find it.  A shuffle of at most SMALL_BYTES is cheaper than one task doing
    the work of all; larger tables have many row groups and never pay for it.
    ``weight``: bytes that a byte of the table becomes before it is worked on;
    what becomes more is dealt out at any size, into tasks of about TASK_BYTES at most.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(spark.sparkContext.defaultParallelism, size * weight // TASK_BYTES if weight > 1 else 0)
    if (1 << 20) < size * weight and (size <= SMALL_BYTES or weight > 1) and len(table.inputFiles()) < parts:
        return table.repartition(parts)
    return table
