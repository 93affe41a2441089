"""Page and in-page search over chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import validate
from docloom.operators import index as ix
from docloom.operators import query as q

#: Longest snippet.
SNIPPET = 800


def over_fetch(limit: int, in_page: bool = False) -> int:
    """Hits read before pages are made unique."""
    cap = min(1000, max(200, 40 * limit))
    return min(2000, max(cap, 80 * limit)) if in_page else cap


def _matches(line: Column, words: list[str]) -> Column:
    low = F.lower(line)
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words], F.lit(0))


def best_line(chunk: Column, query: str) -> Column:
    """Struct (line, offset): the line with most query words, then the longest, then the first.

    Lines are those of the stripped chunk, stripped; the offset counts from 0.
    """
    return best_row(F.transform(tx.lines(tx.strip(chunk)), tx.strip), query)


def best_row(rows: Column, query: str) -> Column:
    """Struct (line, offset): the same of an array of stripped lines; without one that isn't empty, the empty line and no offset."""
    words = q.needles(query)
    scored = F.transform(rows, lambda r, i: F.struct(_matches(r, words).alias("score"), F.length(r).alias("size"), (-i).alias("before"), F.substring(r, 1, SNIPPET).alias("line")))
    top = F.array_max(F.filter(scored, lambda s: s.size > 0))
    return F.struct(F.coalesce(top.line, F.lit("")).alias("line"), (-top.before).alias("offset"))


def line_in_body(body: Column, first: Column, last: Column, query: str, snippet: Column) -> Column:
    """Number of the line in a window of the page that fits snippet and query best; the window's start if none fits."""
    words = q.needles(query)
    rows = tx.lines(body)
    a = F.greatest(F.lit(1), F.least(first, F.size(rows)))
    b = F.greatest(a, F.least(last, F.size(rows)))
    low = F.lower(snippet)
    own = F.filter(
        F.transform(F.split(low, "(?U)\\s+"), lambda w: F.regexp_replace(w, "^[\"',.;:!?()\\[\\]]+|[\"',.;:!?()\\[\\]]+$", "")),
        lambda w: (F.length(w) > 1) & ~w.isin(sorted(q.STOPWORDS)) & ~w.isin(words) if words else (F.length(w) > 1) & ~w.isin(sorted(q.STOPWORDS)),
    )
    own = F.array_distinct(own)

    def score(r: Column, i: Column) -> Column:
        line = F.lower(tx.strip(r))
        exact = F.when((low != "") & line.contains(low), 1000).otherwise(0)
        more = F.size(F.filter(own, lambda w: line.contains(w)))
        return F.struct((exact + 100 * (_matches(line, words) + more)).alias("score"), F.length(line).alias("size"), (-i).alias("before"))

    top = F.array_max(F.filter(F.transform(F.slice(rows, a, b - a + 1), score), lambda s: s.size > 0))
    return F.when(F.size(rows) == 0, F.lit(None).cast("int")).when(F.coalesce(top.score, F.lit(0)) <= 0, a).otherwise(a - top.before)


def decorate(hits: DataFrame, chunks: DataFrame, pages: DataFrame, query: str) -> DataFrame:
    """Add title, snippet and line to hits (url, ord, rank)."""
    found = hits.join(chunks.select("url", "ord", "title", "chunk", "line_start", "line_end"), ["url", "ord"])
    found = found.withColumn("best", best_line(F.col("chunk"), query)).join(pages.select("url", F.col("body").alias("__body")), "url", "left")
    inner = F.col("line_start") + F.coalesce(F.col("best.offset"), F.lit(0))
    outer = line_in_body(F.coalesce("__body", F.lit("")), F.col("line_start"), F.col("line_end"), query, F.col("best.line"))
    line = F.when(tx.strip(F.col("chunk")).contains("\n"), inner).otherwise(outer)
    return found.select("url", "title", F.col("best.line").alias("snippet"), "rank", line.alias("line"), F.col("line_start").alias("chunk_line_start"), F.col("line_end").alias("chunk_line_end"), "ord")


def _scope(pages: DataFrame, source_base: str | None, page: str | None) -> DataFrame | None:
    if source_base is None and page is None:
        return None
    keep = pages
    if source_base is not None:
        keep = keep.where(F.col("source_base") == source_base)
    if page is not None:
        keep = keep.where(F.col("url") == page)
    return keep.select("url")


def ranked(index: ix.Index | None, chunks: DataFrame, pages: DataFrame, query: str, source_base: str | None = None, page: str | None = None) -> DataFrame:
    """(url, ord, rank, stage) of all hits of the first stage that has any; ``index`` None scans the chunks."""
    found = q.stages(query)
    empty = chunks.select("url", "ord").limit(0).withColumn("rank", F.lit(0.0)).withColumn("stage", F.lit(0))
    if not found:
        return empty
    plan = ix.Plan.of(found, index.analyzer if index else "simple")
    if not plan.terms:
        return empty
    hits = ix.look_up(index, plan) if index else ix.scan(chunks, ["url", "ord"], ["title", "chunk"], plan)
    return ix.match(hits, plan, _scope(pages, source_base, page))


def one_per_page(hits: DataFrame, limit: int, cap: int) -> DataFrame:
    """The best hit of each page, after the cap and before the limit."""
    top = hits.orderBy("rank", "url", "ord").limit(cap)
    first = Window.partitionBy("url").orderBy("rank", "ord")
    return top.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").orderBy("rank", "url").limit(limit)


def search(index: ix.Index | None, chunks: DataFrame, pages: DataFrame, query: str, limit: int = 15, source_base: str | None = None) -> DataFrame:
    """Best pages for a query, each with its best chunk's line."""
    validate.number("limit", limit)
    hits = ranked(index, chunks, pages, query, validate.source_base(source_base))
    top = one_per_page(hits, limit, over_fetch(limit))
    return decorate(top, chunks, pages, query).orderBy("rank", "url")


def search_in_page(index: ix.Index | None, chunks: DataFrame, pages: DataFrame, page: str, query: str, limit: int = 15) -> DataFrame:
    """Best chunks of one page."""
    validate.number("limit", limit)
    hits = ranked(index, chunks, pages, query, page=validate.web_url("page_url", page))
    top = hits.orderBy("rank", "url", "ord").limit(min(limit, over_fetch(limit, True)))
    return decorate(top, chunks, pages, query).orderBy("rank", "ord")
