"""Session helpers."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Folder that holds this package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed.

    The folder is added to the workers' module path.  On a cluster whose nodes
    don't share it, install the package or pass it with --py-files.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


#: Most bytes of a batch that a Python worker gets, where the application sets none.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Environment of Python workers, which live from task to task: large arrays go back to the system when they are freed.
_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def workers(spark: SparkSession) -> None:
    """Make Python workers ready: this package importable, memory given back, batches bounded in bytes, since texts can be very long."""
    importable(spark)
    env = spark.sparkContext.environment
    for name, value in _MEMORY.items():
        env.setdefault(name, value)
    if not spark.sparkContext.getConf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


_BROADCAST_KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """What runs within joins by shuffle, never by a broadcast through the driver.

    For jobs whose tables all grow together: the planner takes checkpointed
    tables for much smaller than they are.
    """
    held = {k: spark.conf.get(k, None) for k in _BROADCAST_KEYS}
    for k in _BROADCAST_KEYS:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
