"""Embedding near-dedup: an exact metric range join.

On the unit sphere a cosine of at least c is a distance of at most
``r = sqrt(2 - 2c)``.  Pivots, chosen by hash of the id, partition the vectors:
each belongs to the cell of its nearest pivot.  By the triangle inequality a
vector x can only have a partner in the cell of pivot j if
``d(x, j) <= d(x, own) + 2r``, and more sharply if its distance to the plane
between the two pivots, ``(d(x, j)^2 - d(x, own)^2) / (2 d(own, j))``, is at
most r; it is copied to just those cells, and each cell is joined on its own.
A cell holds its own vectors in chunks of bounded size and streams what it
compares against them.

Equal vectors are one class with a multiplicity.  A cell returns link counts
and a spanning forest, never pairs; forests are joined by connected
components.  Candidates come from single-precision products with a margin;
the cosine that decides is in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, as do vectors of different lengths; a null id
counts as a link of others but is no component id; repeated rows link with
each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import stars
from docloom.llm.runtime import cut, shuffle_width, workers
from docloom.llm.text import mix


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    #: Vectors for each pivot, and the most of a cell's own vectors that one task holds.
    cell: int = 4096
    #: Most pivots (their table is broadcast); beyond it cells have more chunks.
    max_pivots: int = 1024
    #: Slack of the bounds and of the single-precision candidates.
    slack: float = 1e-3


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def classes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec, rep, copies) for each distinct usable vector."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    good = table.select(vec.alias("vec"), F.col(f"`{id_col}`").cast("long").alias("id")).where(
        F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    return good.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def _cells(points: DataFrame, dim: int, count: int, s: Settings) -> DataFrame:
    """(cell, chunk, turn, key, copies, vec): each vector in its own cell (turn 0) and where else it is compared."""
    spark = points.sparkSession
    n = max(1, min(s.max_pivots, round(count / s.cell)))
    pivots = points.orderBy(F.xxhash64("key"), "key").limit(n).select("vec").toArrow().column("vec").combine_chunks()
    if isinstance(pivots, pa.ChunkedArray):
        pivots = pa.concat_arrays(pivots.chunks)
    P = _unit(_matrix(pivots, dim))
    apart = np.sqrt(np.maximum(2 - 2 * P @ P.T, 1e-12))
    shared = spark.sparkContext.broadcast((P, apart))
    r = np.sqrt(2 - 2 * s.cosine)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        P, _ = shared.value
        for batch in batches:
            own = (_unit(_matrix(batch.column(0), dim)) @ P.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32))], names=["cell"])

    workers(spark)
    sizes = np.zeros(len(P), np.int64)
    for row in points.select("vec").mapInArrow(nearest, "cell int").groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes[row.cell] = row.n
    # A hot cell's own vectors are salted into chunks; what it compares goes to each chunk.
    chunks = np.maximum(1, -(-sizes // s.cell))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        P, apart = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                X = _unit(_matrix(part.column(0), dim))
                near = X @ P.T
                own = near.argmax(1)
                sq = np.maximum(2 - 2 * near, 0)
                mine = sq[np.arange(len(X)), own]
                plane = (sq - mine[:, None]) / (2 * apart[own])
                go = (plane <= r + s.slack) & (np.sqrt(sq) <= np.sqrt(mine)[:, None] + 2 * r + s.slack)
                go[np.arange(len(X)), own] = True
                row, cell = np.nonzero(go)
                times = chunks[cell]
                chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                key = part.column(1).to_numpy(zero_copy_only=False)[row]
                home = (own[row] == cell) & (mix(key.view(np.uint64)) % chunks[cell].astype(np.uint64) == chunk.astype(np.uint64))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array((~home).astype(np.int32)), pa.array(key), part.column(2).take(take), part.column(0).take(take)],
                    names=["cell", "chunk", "turn", "key", "copies", "vec"],
                )

    return points.select("vec", "key", "copies").mapInArrow(deal, "cell int, chunk int, turn int, key long, copies long, vec array<double>")


class _Chunk:
    """A chunk of a cell's own vectors and what was found for them."""

    def __init__(self, key: np.ndarray, X: np.ndarray, s: Settings):
        self.key, self.X, self.s = key, X, s
        self.unit = _unit(X)
        self.small = self.unit.astype(np.float32)
        self.links = np.zeros(len(key), np.int64)
        self.label = key.copy()

    def meet(self, key: np.ndarray, X: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count links to these vectors; return edges of a spanning forest of them."""
        V, P = [], []
        unit = _unit(X)
        for a in range(0, len(key), 512):
            k, c = key[a : a + 512], copies[a : a + 512]
            i, j = np.nonzero(self.small @ unit[a : a + 512].astype(np.float32).T >= self.s.cosine - self.s.slack)
            differs = self.key[i] != k[j]
            i, j = i[differs], j[differs]
            if not len(i):
                continue
            x, y = self.X[i], X[a : a + 512][j]
            cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            near = cosine >= self.s.cosine
            i, j = i[near], j[near]
            np.add.at(self.links, i, c[j])
            before, theirs = self.label.copy(), k.copy()
            while len(i):  # least label over the links until nothing changes
                old = (self.label.copy(), theirs.copy())
                np.minimum.at(theirs, j, self.label[i])
                np.minimum.at(self.label, i, theirs[j])
                if (old[0] == self.label).all() and (old[1] == theirs).all():
                    break
            hit = np.unique(j)
            V += [k[hit], before[before != self.label]]
            P += [theirs[hit], self.label[before != self.label]]
        V, P = (np.concatenate(V), np.concatenate(P)) if V else (key[:0], key[:0])
        return V[V != P], P[V != P]


def join(points: DataFrame, dim: int, count: int, s: Settings) -> DataFrame:
    """Rows (v, p, n): edges with n null, and link counts of v with p null."""
    # Own vectors come first, then all that their chunk meets.
    dealt = _cells(points, dim, count, s)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict | None = None

        def result(c: _Chunk) -> pd.DataFrame:
            some = c.links > 0
            return pd.DataFrame({"v": c.key[some], "p": None, "n": c.links[some]}).astype({"p": "Int64", "n": "Int64"})

        def edges(v: np.ndarray, p: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"v": v, "p": p, "n": None}).astype({"p": "Int64", "n": "Int64"})

        for batch in batches:
            cell, chunk, turn = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            key, copies = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
            X = _matrix(batch.column(5), dim)
            group = cell.astype(np.int64) * (1 << 32) + chunk
            bounds = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(turn) != 0)) + 1), len(group)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a == b:
                    continue
                if held is None or held["group"] != group[a]:
                    if held and held["chunk"]:
                        yield result(held["chunk"])
                    held = {"group": group[a], "own": [], "chunk": None}
                if turn[a] == 0:
                    held["own"].append((key[a:b], X[a:b], copies[a:b]))
                    continue
                if held["chunk"] is None:
                    yield from (edges(*x) for x in start(held))
                if held["chunk"]:
                    yield edges(*held["chunk"].meet(key[a:b], X[a:b], copies[a:b]))
        if held:
            if held["chunk"] is None:
                yield from (edges(*x) for x in start(held))
            if held["chunk"]:
                yield result(held["chunk"])

    def start(held: dict) -> list:
        if not held["own"]:
            return []
        key, X, copies = (np.concatenate([x[i] for x in held["own"]]) for i in range(3))
        held["chunk"] = _Chunk(key, X, s)
        held["own"] = []
        return [held["chunk"].meet(key, X, copies)]

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in compare(batches):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    workers(points.sparkSession)
    width = shuffle_width(points.sparkSession)
    return dealt.repartition(width, "cell", "chunk").sortWithinPartitions("cell", "chunk", "turn").mapInArrow(framed, "v long, p long, n long")


def run(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    found = classes(table, id_col, vec_col)
    # Numbered by their ids; a class whose ids are all null has a negative hash instead.
    points = cut(found.withColumn("key", F.coalesce("rep", -F.abs(F.xxhash64("vec")) - 1)))
    sizes = {r.d: r.n for r in points.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()}
    parts = [join(points.where(F.size("vec") == d), d, n, s) for d, n in sorted(sizes.items())]
    if parts:
        pairs = parts[0]
        for p in parts[1:]:
            pairs = pairs.unionByName(p)
        pairs = cut(pairs)
        counts = pairs.where("n is not null").groupBy(F.col("v").alias("key")).agg(F.sum("n").alias("others"))
        roots = stars(pairs.where("p is not null").select("v", "p"))
        least = roots.groupBy("p").agg(F.min(F.when(F.col("v") >= 0, F.col("v"))).alias("v"))
        # A component led by a class without ids takes its least id.
        roots = roots.join(least.withColumnRenamed("v", "real"), "p", "left").select(F.col("v").alias("key"), F.when(F.col("p") >= 0, F.col("p")).otherwise(F.col("real")).alias("root"))
        roots = roots.unionByName(least.where("p < 0").select(F.col("p").alias("key"), F.col("v").alias("root")))
        joined = points.join(counts, "key", "left").join(roots, "key", "left")
        solved = joined.select("vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    else:
        solved = points.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    ident = F.col(f"`{id_col}`")
    rows = table.select(ident.alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    out = rows.join(solved, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
