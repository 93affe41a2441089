"""Connected components of a distributed edge table.

Alternating large-star and small-star rounds contract every component to a
star around its smallest id.  All rounds are joins and partial aggregates;
each ends in a reliable checkpoint, and only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.runtime import cut, shuffle_width


#: Edges of a task in the rounds; few edges are held by few tasks, whose checkpoints are few files.
TASK_EDGES = 50_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "p").cast("decimal(20,0)"))).first()
    return (row[0], row[1])


def _packed(df: DataFrame, n: int) -> DataFrame:
    """A checkpoint of about n rows, in as many tasks as they need."""
    return cut(df.coalesce(min(shuffle_width(df.sparkSession), 1 + n // TASK_EDGES)))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("p").alias("v"), F.col("v").alias("p")))
    # Checkpointed, so that both sides of the join are plain exchanges and Spark can split a hot vertex.
    least = _packed(both.groupBy("v").agg(F.min("p").alias("m")).select("v", F.least("v", "m").alias("m")), n)
    # Every larger neighbour of v points to the least id around v.
    return both.where(F.col("p") > F.col("v")).join(least, "v").select(F.col("p").alias("v"), F.col("m").alias("p"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("p").alias("m"))
    # Every smaller neighbour of v, and v, point to the least of them.
    moved = edges.join(least, "v").where(F.col("p") > F.col("m")).select(F.col("p").alias("v"), F.col("m").alias("p"))
    return moved.unionByName(least.select("v", F.col("m").alias("p"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(v, p): every vertex but the smallest of each component, and that smallest id.

    ``edges`` has two long columns, v and p.  Loops, nulls and repeated edges
    are ignored.  Vertices without edges don't appear.  Many edges may meet in
    a smaller end; the operators give no vertex many smaller neighbours, since
    each of its cells links it to one.
    """
    edges = edges.where(F.col("v").isNotNull() & F.col("p").isNotNull() & (F.col("v") != F.col("p")))
    now = cut(edges.select(F.greatest("v", "p").alias("v"), F.least("v", "p").alias("p")).distinct())
    state = _state(now)
    while state[0]:
        then = _packed(_small_star(_large_star(now, state[0])), state[0])
        if (after := _state(then)) == state:
            return then
        now, state = then, after
    return now
