"""Mixing sources to target weights by Poisson replication.

A source of ``size`` bytes with target weight w out of all weights W should
hold w / W of a corpus of ``total`` bytes, so its documents repeat
``w / W * total / size`` times on average.  Each document's number of copies
is a Poisson count with that mean: a number in [0, 1) from a hash of seed and
id is put through the inverse of the distribution function.  Documents are
exploded by their counts and dealt out in the order of a hash of seed, id and
copy, which is a global shuffle.

The inverse is looked up in the distribution function at the counts within
twelve standard deviations and 40 of the mean, where all but less than 1e-30
of the mass lies; a rate takes O(sqrt(rate)) memory in a worker, and nothing
that grows with the rate travels with a document.  Copies are exploded in
blocks, so that no array grows with their number either.

Defined results: a null source is a source of its own; null and empty texts
have size 0, and a source without bytes gets no copies; a null id hashes as
the empty string; repeated rows have the same count and the same place;
input columns named ``copies``, ``copy`` or ``shuffle_key`` are replaced, all
others (``rate`` and ``cdf`` among them) are kept; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.runtime import cut, workers

#: Copies of a document that are exploded at once.
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Settings:
    seed: str = "mix-1"
    #: Target weights by source; others have ``default_weight``.
    weights: dict[str, float] = field(default_factory=dict)
    default_weight: float = 1.0
    #: A table of rates with at most so many sources is broadcast; a larger one is joined by shuffle.
    broadcast_sources: int = 4096


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(__source, __rate): each source's mean repetition."""
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("__source")).agg(F.sum(F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long")).alias("__size"))
    weight = F.lit(float(s.default_weight))
    for name, w in s.weights.items():
        weight = F.when(F.col("__source") == name, F.lit(float(w))).otherwise(weight)
    # A row for each source, used twice below.
    sizes = cut(sizes.where("__size > 0").withColumn("__weight", weight))
    # One row of sums over the sources; joined to them as scalars.
    sums = sizes.agg(F.sum("__weight").alias("w"), F.sum("__size").alias("t")).first()
    rate = F.col("__weight") / F.lit(float(sums.w or 1.0)) * F.lit(float(sums.t or 0)) / F.col("__size")
    return sizes.select("__source", rate.alias("__rate")).where("__rate > 0")


def distribution(rate: float) -> tuple[int, np.ndarray]:
    """The least count that matters, and the Poisson distribution function from it on."""
    spread = 12 * math.sqrt(rate) + 40
    low, high = max(0, math.floor(rate - spread)), math.ceil(rate + spread)
    log_rate = math.log(rate)
    return low, np.cumsum([math.exp(k * log_rate - rate - math.lgamma(k + 1.0)) for k in range(low, high + 1)])


def draw(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Poisson counts: for each number in [0, 1), the counts at which the distribution function is no greater."""
    out = np.zeros(len(u), np.int64)
    for x in np.unique(rate):
        at = np.flatnonzero(rate == x)
        low, cdf = distribution(float(x))
        out[at] = low + np.searchsorted(cdf, u[at], side="right")
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """Docs replicated to the target weights, in a global shuffle.

    Added: ``copies`` (how many there are), ``copy`` (1 to copies) and
    ``shuffle_key`` (16 hexadecimal digits, the order of the result).
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("copies", "copy", "shuffle_key")]
    table = rates(docs, source_col, text_col, s)
    if table.limit(s.broadcast_sources + 1).count() <= s.broadcast_sources:
        table = F.broadcast(table)

    @F.pandas_udf("long")
    def copies(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for u, rate in parts:
            yield pd.Series(draw(u.to_numpy(), rate.to_numpy()))

    workers(docs.sparkSession)
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    # 13 hexadecimal digits are exact in a double.
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(s.seed), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    drawn = docs.select(*kept, key.alias("__key"), u.alias("__u")).join(table, F.col(f"`{source_col}`").eqNullSafe(F.col("__source")))
    drawn = drawn.withColumn("__copies", copies("__u", "__rate")).where("__copies > 0")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__copies - 1) div {_BLOCK}"))).alias("__block")
    drawn = drawn.select(*kept, "__key", "__copies", block)
    copy = F.explode(F.sequence(F.col("__block") * _BLOCK + 1, F.least("__copies", (F.col("__block") + 1) * _BLOCK))).alias("copy")
    out = drawn.select(*kept, "__key", F.col("__copies").alias("copies"), copy)
    place = F.substring(F.md5(F.concat_ws("|", F.lit(s.seed), "__key", F.col("copy").cast("string"))), 1, 16)
    return out.select(*kept, "copies", "copy", place.alias("shuffle_key")).orderBy("shuffle_key", f"`{id_col}`", "copy")


def run(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per copy: doc_id, source, copies, copy, shuffle_key, n_bytes."""
    return mix(docs, s=s).select("doc_id", "source", "copies", "copy", "shuffle_key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


#: DuckDB SQL of run() over documents with the default settings.
SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
s AS (SELECT source, CAST(sum(n_bytes) AS BIGINT) AS size FROM d GROUP BY source HAVING sum(n_bytes) > 0),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM s) * (SELECT sum(size)::DOUBLE FROM s) / size AS rate FROM s),
p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(range(0, (SELECT CAST(ceil(max(rate + 12 * sqrt(rate))) AS BIGINT) + 42 FROM r))) AS k) WHERE k <= rate + 12 * sqrt(rate) + 40),
u AS (SELECT doc_id, source, n_bytes,
             CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS x FROM d),
n AS (SELECT u.doc_id, u.source, u.n_bytes, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.cdf <= u.x) AS copies FROM u)
SELECT doc_id, source, CAST(copies AS BIGINT) AS copies, CAST(copy AS BIGINT) AS copy,
       substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy), 1, 16) AS shuffle_key, n_bytes
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n WHERE copies > 0)
"""
