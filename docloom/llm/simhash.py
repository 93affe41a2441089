"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit set where over half the XXH64 values of a document's
word shingles have it set.  Documents with equal fingerprints are one class;
only classes are compared.  Two fingerprints within ``radius`` bits agree on
at least ``blocks - radius`` of ``blocks`` bit blocks, so those that agree on
some choice of blocks meet in one cell; comparing all tiles of a whole table
would take time that grows with its square.  A cell too large for one task is
cut into tiles by population count and pairs of tiles whose population counts
differ beyond the radius are never made; inside a tile numpy compares by
exclusive-or and bit counts, again skipping such rows.  A tile returns a
spanning forest of its links, never all pairs, and the forests are joined by
distributed connected components over the fingerprints.

With ``percent`` set, documents link instead at that Jaccard similarity of
their shingle sets: see ``simhash_similar``.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows without an id take part and bridge like others, but a component id
is the least id that is not null, and null only where a component has none;
repeated rows share one class; input columns beyond the id and the text play
no part.  ``keep_one`` keeps, of each component, one row: the least by id
(nulls last) and then by the hash of its text, so an id may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.components import stars
from docloom.llm.runtime import add_columns, cut, shuffle_width, workers
from docloom.llm.text import LOWER_TABLE

_TO_SPACE = bytes(32 if 9 <= b <= 13 else LOWER_TABLE[b] for b in range(256))


@dataclass(frozen=True)
class Settings:
    words: int = 4
    radius: int = 4
    seed: int = 42
    #: Most rows that one side of a tile pair holds.
    tile: int = 2048
    #: Jaccard similarity, in percent, at which ``keep_one`` links; by default the radius alone decides.
    percent: int | None = None


def fingerprint(text: bytes, s: Settings = Settings()) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    words = text.translate(_TO_SPACE).split()
    if not words:
        return 0
    if len(words) <= s.words:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - s.words + 1]
        parts = [joined[a:b] for a, b in zip(starts.tolist(), ends[s.words - 1 :].tolist())]
    digest, seed = xxhash.xxh64_digest, s.seed
    raw = np.frombuffer(b"".join([digest(x, seed) for x in parts]), np.uint8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(raw[at : at + (1 << 16)].reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(parts)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, s: Settings = Settings()) -> DataFrame:
    """Docs with ``fp`` (the fingerprint's bits as a signed long) added."""

    def compute(col: pa.Array) -> list[pa.Array]:
        raw = [fingerprint(x, s) if x else 0 for x in col.cast(pa.binary()).to_pylist()]
        return [pa.array(np.array(raw, np.uint64).view(np.int64), pa.int64())]

    return add_columns(docs, text_col, [T.StructField("fp", T.LongType())], compute, keep)


def block_count(classes: int, radius: int) -> int:
    """Bit blocks: as few as keep cells small on average (each adds choices of blocks)."""
    blocks = radius + 1
    while blocks < 2 * radius and classes / 2.0 ** ((blocks - radius) * (64 // blocks)) > 512:
        blocks += 1
    return blocks


def _cells(blocks: int, radius: int) -> list[Column]:
    """For each choice of blocks: its number and the fingerprint's bits there."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(number).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return out


def grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream of frames that is sorted by the keys."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = [frame[c].to_numpy() for c in keys]
        new = np.zeros(len(frame), bool)
        new[0] = True
        for x in k:
            new[1:] |= x[1:] != x[:-1]
        cuts = [*np.flatnonzero(new), len(frame)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = frame.iloc[a:b]
            if held and any(held[-1][c].iloc[-1] != part[c].iloc[0] for c in keys):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def forest(fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, least member) of the links among one tile's rows."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, rep = fp[order], rep[order]
    ones = np.bitwise_count(fp).astype(np.int16)
    label = np.arange(len(fp))
    step = max(1, (1 << 20) // max(1, len(fp)))

    for a in range(0, len(fp), step):
        b = min(len(fp), a + step)
        # Rows are in order of population count: beyond the radius none can link.
        end = int(np.searchsorted(ones, ones[b - 1] + radius, side="right"))
        near = np.bitwise_count(fp[a:b, None] ^ fp[None, a:end]) <= radius
        i, j = np.nonzero(near)
        keep = j > i
        i, j = i[keep] + a, j[keep] + a
        if len(i):
            # The first link of each later row is tried first; most others then are within one set already.
            while len(i):
                ri, rj = label[i], label[j]
                while (label[ri] != ri).any():
                    ri = label[ri]
                while (label[rj] != rj).any():
                    rj = label[rj]
                open_ = ri != rj
                i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
                if len(i):
                    np.minimum.at(label, np.maximum(ri, rj), np.minimum(ri, rj))
    at = label
    while (at[at] != at).any():
        at = at[at]
    least = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(least, at, rep)
    p = least[at]
    moved = rep != p
    return rep[moved], p[moved]


def counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, total): the keys of more than one row; checkpointed."""
    return cut(rows.groupBy(*by).agg(F.count("*").alias("total")).where("total > 1"))


def met(rows: DataFrame, by: list[str], often: DataFrame | None = None) -> DataFrame:
    """Rows with ``total``, the rows that share ``by``; those alone are left out. ``often`` is counted() of the rows, if it is there already."""
    # Checkpointed, so that both sides of the join are plain exchanges and Spark can split a hot cell.
    return cut(rows.join(counted(rows, by) if often is None else often, by))


def tiled(rows: DataFrame, by: list[str], name: str, tile: int, radius: int) -> DataFrame:
    """Rows of met() (by, ones, name, ...) with ``cell``: each row once for each tile pair that it is in.

    Rows that share ``by`` make one cell up to ``tile`` of them; beyond, tiles
    by population count ``ones`` and a hash of ``name``, in the pairs that the
    radius allows.
    """
    small = rows.where(F.col("total") <= tile).withColumn("cell", F.xxhash64(*by)).drop(*by, "total")
    big = rows.where(F.col("total") > tile).drop("total")
    if big.isEmpty():
        return small
    sizes = big.groupBy(*by, "ones").agg(F.count("*").alias("n"))
    # A cell has at most 65 population counts, so its list of them is short.
    layers = sizes.groupBy(*by).agg(F.collect_list(F.struct("ones", F.ceil(F.col("n") / (tile // 2)).alias("parts"))).alias("layers"))
    big = big.join(cut(layers), by)
    part = F.pmod(F.xxhash64(name), F.expr("filter(layers, x -> x.ones = ones)[0].parts"))
    big = big.withColumn("mine", F.col("ones").cast("long") * (1 << 32) + part)
    # The tiles to meet: those whose population counts are within the radius.
    others = F.expr(
        f"flatten(transform(filter(layers, x -> abs(x.ones - ones) <= {radius}), x -> transform(sequence(0L, x.parts - 1), q -> cast(x.ones as long) * {1 << 32} + q)))"
    )
    big = big.withColumn("other", F.explode(others))
    big = big.withColumn("cell", F.xxhash64(*by, F.least("mine", "other"), F.greatest("mine", "other"))).drop(*by, "layers", "mine", "other")
    return small.unionByName(big)


def links(classes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(v, p) edges between fingerprints that connect what links. ``classes``: distinct fp."""
    spark = classes.sparkSession
    blocks = block_count(classes.count(), s.radius)
    cells = classes.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*_cells(blocks, s.radius))).alias("c"))
    by = ["choice", "bits"]
    rows = tiled(met(cells.select("fp", "ones", "c.choice", "c.bits"), by), by, "fp", s.tile, s.radius).select("cell", "fp")
    schema, radius = "v long, p long", s.radius

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for g in grouped(frames, ["cell"]):
            if len(g) > 1:
                fp = np.unique(g["fp"].to_numpy())
                v, p = forest(fp.view(np.uint64), fp, radius)
                if len(v):
                    found.append((v, p))
                    held += len(v)
                if held > 100_000:
                    yield pd.DataFrame({"v": np.concatenate([x for x, _ in found]), "p": np.concatenate([x for _, x in found])})
                    found, held = [], 0
        if found:
            yield pd.DataFrame({"v": np.concatenate([x for x, _ in found]), "p": np.concatenate([x for _, x in found])})

    workers(spark)
    return rows.repartition(shuffle_width(spark), "cell").sortWithinPartitions("cell").mapInPandas(compare, schema)


def components(prints: DataFrame, id_col: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``prints``, which should be checkpointed."""
    classes = cut(prints.groupBy("fp").agg(F.min(F.col(f"`{id_col}`").cast("long")).alias("rep")))
    found = stars(links(classes.select("fp"), s))
    labelled = classes.join(found.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "rep", F.coalesce("p", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    return labelled.select("fp", "label").join(least, "label").select("fp", "component_id")


def run(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = cut(with_fingerprints(docs, keep=["doc_id"], s=s))
    found = components(prints, s=s)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Columns that name a row: whether it has no id, its id, the hash of its text.
ROW = ["__none", "__id", "__h"]


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Docs with the columns of ROW."""
    key = F.col(f"`{id_col}`").cast("long")
    return docs.withColumn("__none", key.isNull()).withColumn("__id", F.coalesce(key, F.lit(0))).withColumn("__h", F.xxhash64(f"`{text_col}`"))


#: Size of the sieves.
BUCKETS = 1 << 22


def sieve(keys: DataFrame, column: str) -> np.ndarray:
    """Which of BUCKETS buckets any key is in, from one word of 64 bits for each 64 buckets.

    It only spares rows that nothing wants, so its fixed size is no limit.
    """
    bucket = keys.select(F.pmod(column, F.lit(BUCKETS)).alias("b"))
    words = bucket.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("word")).toArrow()
    bits = np.zeros(BUCKETS // 64, np.int64)
    bits[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def one_each(rows: DataFrame, cols: list[str], least: DataFrame, found: DataFrame) -> DataFrame:
    """Of the rows of named(), the least of each component. ``least``: (key, r), each class and its least row; ``found``: stars of keys."""
    kept = least.join(found.withColumnRenamed("v", "key"), "key", "left").groupBy(F.coalesce("p", "key")).agg(F.min("r").alias("r")).select("r.*")
    kept = cut(kept)
    # Most rows stay and are alone; those that a sieve can tell never reach the shuffle, which carries whole texts.
    doubtful = rows.groupBy(*ROW).agg(F.count("*").alias("n")).join(kept.withColumn("kept", F.lit(True)), ROW, "left").where("n > 1 or kept is null")
    shared = rows.sparkSession.sparkContext.broadcast(sieve(doubtful.select(F.xxhash64(*ROW).alias("w")), "w"))

    @F.pandas_udf(T.BooleanType())
    def passes(w: pd.Series) -> pd.Series:
        return pd.Series(shared.value[w.to_numpy() % BUCKETS])

    workers(rows.sparkSession)
    out = [F.col(f"`{c}`") for c in cols]
    rows = rows.withColumn("__in", passes(F.xxhash64(*ROW)))
    once = Window.partitionBy(*ROW).orderBy("__h")
    some = rows.where("__in").join(kept, ROW, "left_semi").withColumn("__n", F.row_number().over(once)).where("__n = 1")
    return rows.where("not __in").select(*out).unionByName(some.select(*out))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of docs that stay: one of each component."""
    rows = named(docs, id_col, text_col)
    if s.percent is not None:
        from docloom.llm import simhash_similar

        least, found = simhash_similar.classes(rows, text_col, s)
    else:
        prints = with_fingerprints(rows, text_col, ROW, s)
        least = cut(prints.groupBy(F.col("fp").alias("key")).agg(F.min(F.struct(*ROW)).alias("r")))
        found = stars(links(least.select(F.col("key").alias("fp")), s))
    return one_each(rows, docs.columns, least, found)
