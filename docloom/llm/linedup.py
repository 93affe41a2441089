"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Every line of every document has an ID (the 64-bit hash of its text), and every
line starts a suffix of its document's ID sequence.  A suffix is one long, the
document's number in the order of ids and then the line's, so that the order of
suffixes is the order of places.  Round k ranks the suffixes by their first
2**k lines: the ranks of two halves make a pair, and the sorted distinct pairs
are numbered in order, so ranks are true suffix order.  Suffixes of equal rank
are the members of one longest-common-prefix interval of depth 2**k or more; an
interval with one member is finished and leaves the next rounds, which go on
until none is left.

A run of lines that has an earlier copy is deleted: an interval's first suffix
is kept, the run at each later one goes.  Runs of ``min_lines`` lines are the
intervals of that depth (two overlapping windows of 2**k lines name one of any
length), and the windows of a maximal repeated run cover it, so all of its
later copies go.  Blank lines alone are no repeated run; with ``min_lines`` 1 a
blank line goes if it and a line beside it that isn't blank stand together
elsewhere before.

In a document's deepest interval, of depth 2**k, later suffixes of consecutive
lines whose intervals have consecutive firsts follow one earlier place: c + 1 of
them have a longest common prefix of 2**k + c lines with it, a maximal repeated
run.  ``longest_run`` is the greatest of a document's.

Everything is DataFrame functions; keys are pre-aggregated before they are
joined, and ranks, never groups, are collected by key.

Defined results: null text has no lines and stays null; the empty text is one
empty line; rows that repeat both id and text are one document and get the
same result; null ids come first; a document all of whose lines go becomes the
empty text; lines are split at ``\n`` alone; a line of spaces, tabs and carriage
returns is blank.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.runtime import cut

_NO_ID = -(1 << 63)
_ROW_BITS = 33


@dataclass(frozen=True)
class Settings:
    #: Lines of the shortest run that is deleted.
    min_lines: int = 1


@dataclass
class Suffixes:
    """``ranked``: (s, r, first, solid) of the suffixes whose first line occurs elsewhere; ``first`` is the interval's
    first member, ``solid`` tells whether a line of the run isn't blank. ``names``: (m, d, t), the documents by number."""

    ranked: DataFrame
    names: DataFrame
    #: The lower bits of ``s`` that hold the line number.
    bits: int

    def line(self) -> Column:
        return F.col("s").bitwiseAND((1 << self.bits) - 1)

    def number(self) -> Column:
        return F.shiftright("s", self.bits)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Docs with __d (the id) and __t (hash of the text), which name a document."""
    return docs.withColumn("__d", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID))).withColumn("__t", F.xxhash64(F.col(f"`{text_col}`")))


def _numbered(lines: DataFrame) -> Suffixes:
    """The documents of (d, t, pos, r, solid) numbered in order, and its rows with one long for each suffix."""
    ordered = cut(lines.select("d", "t").distinct().orderBy("d", "t").withColumn("m", F.monotonically_increasing_id()))
    row = F.col("m").bitwiseAND((1 << _ROW_BITS) - 1)
    # One row of three numbers: how many bits the parts of a suffix need.
    top = ordered.agg(F.max(F.shiftright("m", _ROW_BITS)).alias("part"), F.max(row).alias("row")).first()
    longest = lines.agg(F.max("pos")).first()[0]
    row_bits, bits = (top.row or 0).bit_length(), ((longest or 0) + 1).bit_length()
    if (top.part or 0).bit_length() + row_bits + bits > 62:
        raise ValueError("documents and lines are too many for 62 bits")
    names = ordered.select("d", "t", (F.shiftleft(F.shiftright("m", _ROW_BITS), row_bits) + row).alias("m"))
    suffix = lines.join(names, ["d", "t"]).select((F.shiftleft("m", bits) + F.col("pos")).alias("s"), "r", "solid")
    return Suffixes(suffix, names, bits)


def _intervals(suffix: DataFrame, by: list[str]) -> DataFrame:
    """Intervals with more than one member, and their first."""
    ends = suffix.groupBy(*by).agg(F.min("s").alias("first"), F.max("s").alias("last"))
    return ends.where(F.col("first") != F.col("last")).drop("last")


def suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Suffixes:
    """The suffixes, ranked by their first line."""
    line = F.col("line")
    lines = (
        _keyed(docs, id_col, text_col)
        .select(F.col("__d").alias("d"), F.col("__t").alias("t"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("pos", "line"))
        .select("d", "t", F.col("pos").cast("long").alias("pos"), F.xxhash64(line).alias("r"), (F.length(F.btrim(line, F.lit(" \t\r"))) > 0).alias("solid"))
    )
    # Checkpointed, so that both sides of the joins are plain exchanges and Spark can split a hot line.
    often = cut(lines.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r"))
    found = _numbered(cut(lines.join(often, "r")))
    suffix = cut(found.ranked)
    return Suffixes(cut(suffix.join(cut(_intervals(suffix, ["r"])), "r").select("s", "r", "first", "solid")), found.names, found.bits)


def _with_ahead(x: Suffixes, ranked: DataFrame, step: int) -> DataFrame:
    """Ranked suffixes with b and more: rank and solid of the suffix ``step`` lines on in the same document, if it has one."""
    there = Window.partitionBy("m").orderBy("s").rangeBetween(step, step)
    return ranked.withColumn("m", x.number()).withColumns({"b": F.first("r").over(there), "more": F.first("solid").over(there)})


def _pairs(ahead: DataFrame) -> DataFrame:
    """(s, a, b, solid): the suffixes with a second rank."""
    return ahead.where("b is not null").select("s", F.col("r").alias("a"), "b", (F.col("solid") | F.col("more")).alias("solid"))


def walk(x: Suffixes, ranked: DataFrame, depth: int) -> DataFrame:
    """A round's suffixes with what the next round needs, and ``run``.

    ``run``, of a later suffix, is the length of the run that ends with its
    window and follows one earlier place line by line.  A task holds the
    suffixes of one document at a time.
    """
    near = Window.partitionBy("m").orderBy("s")
    later = F.col("first") < F.col("s")
    follows = later & (F.lag("s").over(near) == F.col("s") - 1) & (F.lag("first").over(near) == F.col("first") - 1)
    begun = F.last(F.when(later & ~F.coalesce(follows, F.lit(False)), F.col("s")), ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, 0))
    return cut(_with_ahead(x, ranked, depth).withColumn("run", F.when(later, F.col("s") - begun + depth)))


def double(walked: DataFrame) -> DataFrame:
    """Ranks by twice as many lines, of the suffixes that share them."""
    pairs = _pairs(walked)
    # Numbers that grow with the sorted pairs: the order of the suffixes.
    names = _intervals(pairs, ["a", "b"]).orderBy("a", "b").withColumn("r", F.monotonically_increasing_id())
    return pairs.join(names, ["a", "b"]).select("s", "r", "first", "solid")


def _windows(x: Suffixes, walked: DataFrame, depth: int, size: int) -> DataFrame:
    """The later suffixes of the intervals of ``size`` lines, depth <= size < 2 * depth, that aren't all blank."""
    found = walked
    if size > depth:
        pairs = _pairs(_with_ahead(x, walked.select("s", "r", "solid"), size - depth))
        found = pairs.join(_intervals(pairs, ["a", "b"]), ["a", "b"])
    return found.where(F.col("solid") & (F.col("first") < F.col("s"))).select("s")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(__d, __t, gone, longest): sorted numbers of a document's lines to delete, and its longest run that occurs earlier."""
    if s.min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    x = suffixes(docs, id_col, text_col)
    depth, lines, runs = 1, [], []
    # A blank line goes with a neighbour that isn't blank.
    sizes = (1, 2) if s.min_lines == 1 else (s.min_lines,)
    walked = walk(x, x.ranked, depth)
    while True:
        for size in sizes:
            if depth <= size < 2 * depth:
                later = _windows(x, walked, depth, size)
                lines.append(later.select(F.explode(F.sequence(F.col("s"), F.col("s") + (size - 1))).alias("s")) if size > 1 else later)
        runs.append(walked.where("run is not null").groupBy("m").agg(F.max("run").alias("run")).withColumn("depth", F.lit(depth)))
        if walked.where("b is not null").isEmpty():
            break
        walked, depth = walk(x, double(walked), 2 * depth), 2 * depth
    gone = walked.select("s").where(F.lit(False))
    for part in lines:
        gone = gone.unionByName(part)
    gone = gone.groupBy(x.number().alias("m")).agg(F.sort_array(F.collect_set(x.line().cast("int"))).alias("gone"))
    longest = reduce(DataFrame.unionByName, runs).groupBy("m").agg(F.max_by("run", "depth").alias("longest"))
    found = gone.join(longest, "m", "full").join(x.names, "m")
    return found.select(F.col("d").alias("__d"), F.col("t").alias("__t"), "gone", F.when(F.col("longest") >= s.min_lines, F.col("longest")).alias("longest"))


def _mark(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """Docs with __lines, __gone, __kept (the text that stays) and __longest."""
    found = find_copies(docs, id_col, text_col, s).select("__d", "__t", F.col("gone").alias("__gone"), F.col("longest").alias("__longest"))
    out = _keyed(docs, id_col, text_col).join(found, ["__d", "__t"], "left")
    out = out.withColumn("__lines", F.split(F.col(f"`{text_col}`"), "\n", -1))
    # Between two neighbouring deleted lines lies a run that stays.
    edges = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size("__lines")))
    runs = F.expr("transform(sequence(0, size(__edges) - 2), i -> slice(__lines, __edges[i] + 2, __edges[i + 1] - __edges[i] - 1))")
    touched = F.coalesce(F.size("__gone"), F.lit(0)) > 0
    out = out.withColumn("__edges", F.when(touched, edges))
    return out.withColumn("__kept", F.when(touched, F.array_join(F.flatten(runs), "\n")).otherwise(F.col(f"`{text_col}`")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """Docs with the later copies of repeated line runs deleted from the text; same columns."""
    cols = docs.columns
    out = _mark(docs, id_col, text_col, s)
    return out.select(*[F.col("__kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in cols])


def run(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_spans, longest_run, kept_sha256 (of "" for null)."""
    out = _mark(docs.select("doc_id", "text"), "doc_id", "text", s)
    spans = F.size(F.filter(F.col("__gone"), lambda x, i: (i == 0) | (F.element_at("__gone", F.greatest(i, F.lit(1))) != x - 1)))
    return out.select(
        "doc_id",
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(spans, F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("__longest", F.lit(0)).cast("long").alias("longest_run"),
        F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"),
    )


#: DuckDB SQL of run() over documents with unique, non-null ids and the default settings.
SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, lines FROM l),
w AS (SELECT doc_id, i, k, sha256(array_to_string(lines[i:i + (1 << k) - 1], chr(10))) AS run,
             length(trim(array_to_string(lines[i:i + (1 << k) - 1], ''), ' ' || chr(9) || chr(13))) > 0 AS solid
      FROM p, (SELECT unnest(range(0, (SELECT CAST(floor(log2(max(len(lines)))) AS BIGINT) + 1 FROM l))) AS k) WHERE i + (1 << k) - 1 <= len(lines)),
v AS (SELECT *, first_value(doc_id) OVER x AS fd, first_value(i) OVER x AS fi FROM w WINDOW x AS (PARTITION BY k, run ORDER BY doc_id, i)),
f AS (SELECT * FROM v WHERE fd <> doc_id OR fi <> i),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN k = 0 THEN [i] ELSE [i, i + 1] END) AS i FROM f WHERE k <= 1 AND solid),
s AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
n AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT island) AS n_spans FROM s GROUP BY doc_id),
e AS (SELECT doc_id, max(k) AS k FROM f GROUP BY doc_id),
c AS (SELECT f.doc_id, f.k, fd, f.i - fi AS shift, f.i - row_number() OVER (PARTITION BY f.doc_id, fd, f.i - fi ORDER BY f.i) AS island FROM f JOIN e ON e.doc_id = f.doc_id AND e.k = f.k),
r AS (SELECT doc_id, count(*) + (1 << any_value(k)) - 1 AS run FROM c GROUP BY doc_id, fd, shift, island),
d AS (SELECT doc_id, max(run) AS longest_run FROM r GROUP BY doc_id),
t AS (SELECT p.doc_id, string_agg(p.lines[p.i], chr(10) ORDER BY p.i) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i
      WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT l.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN n ON n.doc_id = l.doc_id LEFT JOIN d ON d.doc_id = l.doc_id LEFT JOIN t ON t.doc_id = l.doc_id
"""
