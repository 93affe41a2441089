"""Shared Spark plumbing of the training-data operators.

Column names that begin with two underscores are the operators' own; all
others may stand in an input, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.session import workers
from docloom.operators.store import cut, shared_folder
from docloom.sources import tables

__all__ = ["add_columns", "cut", "join_counted", "keep_rows", "read_table", "shared_folder", "shuffle_width", "workers"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, sf_dir, name)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A key with more than this share of all rows is hot; so at most as many keys are.
HOT_SHARE = 1024


def join_counted(rows: DataFrame, table: DataFrame, by: list[str], n: str) -> DataFrame:
    """Rows joined with a checkpointed table of distinct keys, whose column ``n`` counts the rows of each.

    Keys with over 1 / HOT_SHARE of all rows are fewer than HOT_SHARE: they are
    broadcast, and their rows stay where they are.  Rows of other keys are
    dealt by key, none of which fills a task.
    """
    total, most = table.agg(F.sum(n), F.max(n)).first()
    limit = max(1 << 12, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return rows.join(table, by)
    hot = F.broadcast(table.where(F.col(n) > limit))
    return rows.join(hot, by).unionByName(rows.join(hot.select(*by), by, "left_anti").join(table.where(F.col(n) <= limit), by))


def add_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    compute: Callable[[pa.Array], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed batch-wise from one text column.

    ``compute`` takes the Arrow column of a batch and returns one Arrow array
    per field, in order.  ``keep`` names the input columns that stay (all by
    default); an input column with the name of an added one is replaced.
    Batches stream, so a task holds one at a time.
    """
    names = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    passed = [F.col(f"`{c}`") for c in kept]
    # A text that isn't kept, or is replaced, travels last, under a name of its own.
    own = text_col not in kept
    inner = df.select(*passed, *[F.col(f"`{text_col}`").alias("__text")] * own)
    at = len(kept) if own else kept.index(text_col)
    schema = T.StructType([*inner.schema.fields[: len(kept)], *fields])
    arrow_names, n_kept = [f.name for f in schema.fields], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *compute(batch.column(at))], names=arrow_names)

    workers(df.sparkSession)
    return inner.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, test: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, as they are, whose text passes; ``test`` takes a batch's text column and returns a boolean for each row."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(test(batch.column(at)), pa.bool_()))

    workers(df.sparkSession)
    return df.mapInArrow(run, df.schema)
