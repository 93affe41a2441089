"""Full-text index: postings with positions, row lengths, and BM25 match plans.

An index covers the text columns of keyed rows.  ``scan`` answers a query from
the rows themselves in one pass without a shuffle; ``build`` lays out postings
by term, so that a query reads only its own terms.  Both give the same hits.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import analyze
from docloom.functions.session import workers
from docloom.operators.query import Stage

K1, B = 1.2, 0.75
#: Positions of the k-th text column start at k times this, so no phrase spans two columns.
COLUMN_STEP = 1 << 26


@dataclass(frozen=True)
class Index:
    """``postings``: term, keys, length, positions; ``lengths``: keys, length (tokens of all columns).

    A posting holds its row's length, so that a query never joins the lengths.
    ``totals`` (n, mean), one row, is what a query needs of all lengths; a
    stored index keeps it, so that no query reads them.
    """

    postings: DataFrame
    lengths: DataFrame
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    analyzer: str
    totals: DataFrame | None = None


def totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def _grouped(parts: Column) -> Column:
    """Array of (token, positions) of the parts (base, tokens) of one row: tokens are sorted, and each run of equal ones is cut out."""
    at = F.flatten(F.transform(parts, lambda p: F.transform(p.tokens, lambda t, i: F.struct(t.alias("token"), (p.base + i).alias("at")))))
    # Sorted once, in a place of its own, since the cuts refer to it again and again.
    return F.transform(F.array(F.sort_array(at)), _runs)[0]


def _runs(seen: Column) -> Column:
    begins = F.filter(F.transform(seen, lambda x, i: F.when((i == 0) | (F.get(seen, i - 1).token != x.token), i)), lambda i: i.isNotNull())

    def cut_out(begins: Column) -> Column:
        def run(i: Column, k: Column) -> Column:
            part = F.slice(seen, i + 1, F.coalesce(F.get(begins, k + 1), F.size(seen)) - i)
            return F.struct(F.get(seen, i).token.alias("token"), F.transform(part, lambda x: x["at"]).alias("positions"))

        return F.transform(begins, run)

    return F.transform(F.array(begins), cut_out)[0]


def build(rows: DataFrame, keys: list[str], columns: list[str], analyzer: str = "english") -> Index:
    """Index rows, each of keys of its own, by their text columns.

    A row's postings are made where the row is, so that occurrences are never shuffled.
    """
    parts = F.array(*[F.struct(F.lit(i * COLUMN_STEP).alias("base"), analyze.tokens(F.col(c)).alias("tokens")) for i, c in enumerate(columns)])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.size(p.tokens))
    tokenised = rows.select(*keys, parts.alias("parts")).select(*keys, length.alias("length"), "parts")
    lengths = tokenised.select(*keys, "length")
    postings = tokenised.select(*keys, "length", F.explode(_grouped(F.col("parts"))).alias("p")).select(F.col("p.token").alias("term"), *keys, "length", "p.positions")
    if analyzer == "english":
        workers(rows.sparkSession)
        # Stems of the distinct vocabulary, joined back; a row's tokens of one stem are put together.
        vocabulary = postings.select(F.col("term").alias("token")).distinct().withColumn("term", analyze.english_terms("token"))
        stemmed = postings.withColumnRenamed("term", "token").join(vocabulary, "token")
        postings = stemmed.groupBy("term", *keys, "length").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return Index(postings, lengths, tuple(keys), tuple(columns), analyzer)


@dataclass(frozen=True)
class Plan:
    """A query's phrases as term lists, and its stages over them."""

    phrases: tuple[tuple[str, ...], ...]
    stages: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]

    @classmethod
    def of(cls, stages: list[Stage], analyzer: str) -> "Plan":
        number: dict[tuple[str, ...], int] = {}
        key = lambda t: number.setdefault(tuple(analyze.query_terms(t, analyzer)), len(number))
        found = tuple((tuple(key(t) for t in s.every), tuple(key(t) for t in s.some)) for s in stages)
        return cls(tuple(number), found)

    @property
    def terms(self) -> list[str]:
        return sorted({t for p in self.phrases for t in p})


@dataclass(frozen=True)
class Hits:
    """``rows``: keys, length and f_j, the frequency of phrase j.

    ``total`` and ``mean`` (rows of the index, their mean length) are None if
    ``rows`` are all rows of the index, so that they can be taken from them.
    """

    rows: DataFrame
    total: float | None = None
    mean: float | None = None


_BEFORE = "(?<![\\p{L}\\p{N}\\p{Co}]\\p{M}{0,8}%s)"
_AFTER = "(?![\\p{L}\\p{N}\\p{Co}\\p{M}])"
_BETWEEN = "[^\\p{L}\\p{N}\\p{Co}]+"


def _occurrences(text: Column, phrase: tuple[str, ...]) -> Column:
    """Places in lower-case text where the phrase's tokens follow each other; overlapping ones count."""
    if not phrase:
        return F.lit(0)
    # The first token is looked for as plain text, and what stands around it only where it is found.
    first, ahead = re.escape(phrase[0]), "".join(f"{_BETWEEN}{re.escape(t)}" for t in phrase[1:])
    pattern = first + _BEFORE % first + (f"(?={ahead}{_AFTER})" if ahead else _AFTER)
    # A plain search for the terms is much cheaper than the pattern, and most rows fail it.
    held = reduce(lambda a, b: a & b, [text.contains(t) for t in dict.fromkeys(phrase)])
    return F.when(held, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).otherwise(0)


def scan(rows: DataFrame, keys: list[str], columns: list[str], plan: Plan, only: list[str] | None = None) -> Hits:
    """Frequencies from the rows, by the simple analyzer. ``only``: columns that may match."""
    add = lambda a, b: a + b
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns}
    length = reduce(add, [F.size(analyze.tokens(F.col(c))) for c in columns]).cast("long")
    counts = [reduce(add, [_occurrences(low[c], p) for c in columns if only is None or c in only]).alias(f"f_{j}") for j, p in enumerate(plan.phrases)]
    return Hits(rows.select(*keys, length.alias("length"), *counts))


def _frequency(phrase: tuple[str, ...], terms: list[str]) -> Column:
    """Occurrences of a phrase in a row of per-term positions ``at_i``; 0 for a phrase without terms."""
    if not phrase:
        return F.lit(0)
    at = [F.col(f"at_{terms.index(t)}") for t in phrase]
    if len(at) == 1:
        return F.size(at[0])
    return F.size(F.filter(at[0], lambda p: reduce(lambda a, b: a & b, [F.array_contains(x, p + i) for i, x in enumerate(at[1:], 1)])))


def look_up(index: Index, plan: Plan, only: list[str] | None = None) -> Hits:
    """Frequencies from the postings of the query's terms. ``only``: columns that may match."""
    keys = list(index.keys)
    stats = (totals(index.lengths) if index.totals is None else index.totals).first() or (0, None)
    found = index.postings.where(F.col("term").isin(plan.terms))
    if only is not None:
        bases = [i for i, c in enumerate(index.columns) if c in only]
        found = found.withColumn("positions", F.filter("positions", lambda p: F.floor(p / COLUMN_STEP).isin(bases)))
    # At most one entry for each term of the query.
    merged = found.groupBy(*keys).agg(F.max("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    none = F.array().cast("array<int>")
    hits = merged.select(*keys, "length", *[F.coalesce(F.col("at")[t], none).alias(f"at_{i}") for i, t in enumerate(plan.terms)])
    return Hits(hits.select(*keys, "length", *[_frequency(p, plan.terms).alias(f"f_{j}") for j, p in enumerate(plan.phrases)]), float(stats[0]), stats[1])


def _flag(stage: tuple[tuple[int, ...], tuple[int, ...]]) -> Column:
    every, some = stage
    has = lambda j: F.col(f"f_{j}") > 0
    tests = [has(j) for j in every] + ([reduce(lambda a, b: a | b, map(has, some))] if some else [])
    return reduce(lambda a, b: a & b, tests)


def match(hits: Hits, plan: Plan, scope: DataFrame | None = None) -> DataFrame:
    """Keys, rank (BM25, smaller is better) and stage of the rows that the first stage with a hit matches.

    Frequencies across the index weigh phrases whatever the scope, a table of
    keys that restricts the result.
    """
    phrases, rows = range(len(plan.phrases)), hits.rows
    flags = [F.max(_flag(s)).alias(f"s_{i}") for i, s in enumerate(plan.stages)]
    # One row of numbers: of the index, of each phrase, and whether a stage has hits.
    held = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.coalesce(F.sum((F.col(f"f_{j}") > 0).cast("long")), F.lit(0)).alias(f"n_{j}") for j in phrases], *flags).first()
    inside = rows if scope is None else rows.join(scope, scope.columns, "left_semi")
    first = held if scope is None else inside.agg(*flags).first()
    at = next((i for i in range(len(plan.stages)) if first[f"s_{i}"]), None)
    if at is None:
        return inside.limit(0).withColumn("rank", F.lit(0.0)).withColumn("stage", F.lit(0)).drop("length", *[f"f_{j}" for j in phrases])
    every, some = plan.stages[at]
    total, mean = (held.n, held.mean) if hits.total is None else (hits.total, hits.mean)

    def part(j: int) -> Column:
        n = held[f"n_{j}"]
        idf = math.log((total - n + 0.5) / (n + 0.5))
        f = F.col(f"f_{j}").cast("double")
        return (idf if idf > 0 else 1e-6) * (f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(mean))))

    score = reduce(lambda a, b: a + b, [part(j) for j in (*every, *some)])
    out = inside.where(_flag(plan.stages[at])).withColumn("rank", -score).withColumn("stage", F.lit(at + 1))
    return out.drop("length", *[f"f_{j}" for j in phrases])
