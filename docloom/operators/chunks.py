"""Chunks: pages cut into searchable pieces that know their lines.

Paragraphs are packed greedily up to a size; what is still too long is split
with an overlap.  Packing depends on the order, so a page is one row of an
Arrow function; pages are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.session import workers


@dataclass(frozen=True)
class Settings:
    size: int = 2200
    overlap: int = 180
    least: int = 380


@dataclass(frozen=True)
class Span:
    text: str
    first: int
    last: int


def paragraphs(rows: list[str]) -> list[Span]:
    """Runs of lines that aren't blank."""
    out = []
    for blank, run in groupby(enumerate(rows, 1), key=lambda r: not r[1].strip()):
        if not blank:
            found = list(run)
            out.append(Span("\n".join(r for _, r in found).strip(), found[0][0], found[-1][0]))
    return out


def pack(parts: list[Span], sep: str, full) -> list[Span]:
    """Join neighbours by ``sep`` until ``full(size so far, size with the next)``."""
    out: list[list[Span]] = []
    size = 0
    for p in parts:
        grown = size + len(sep) + len(p.text)
        if out and not full(size, grown):
            out[-1].append(p)
            size = grown
        else:
            out.append([p])
            size = len(p.text)
    return [Span(sep.join(p.text for p in g), g[0].first, g[-1].last) for g in out]


def hard_split(span: Span, s: Settings = Settings()) -> list[Span]:
    """Pieces of at most ``size`` characters, each but the first begun ``overlap`` earlier.

    Lines are counted where the text has line breaks, and else scaled by position, halves to even.
    """
    n, step = len(span.text), s.size - s.overlap
    if n <= s.size:
        return [span]

    def scaled(at: int) -> int:
        return min(span.last, span.first + round((span.last - span.first) * (at / (n - 1))))

    out = []
    for a in range(0, max(1, n - s.overlap), step):
        piece = span.text[a : a + s.size]
        if "\n" in span.text:
            first = span.first + span.text.count("\n", 0, a)
            last = first + piece.count("\n")
        else:
            first = scaled(a)
            last = max(first, scaled(a + len(piece) - 1))
        out.append(Span(piece, first, last))
    return out


def spans(body: str, s: Settings = Settings()) -> list[Span]:
    """The chunks of one page; an empty page has one empty chunk, so that its title is found."""
    rows = body.splitlines()
    parts = paragraphs(rows)
    if not parts:
        return [Span("", 1, 1)]
    if len(parts) == 1 and parts[0].text.count("\n") > 8 and "\n\n" not in body.strip():
        # One block of single line breaks: lines are packed to nearly the size first.
        near = s.size * 0.9
        parts = [Span(r.strip(), i, i) for i, r in enumerate(rows, 1) if r.strip()]
        parts = pack(parts, " ", lambda _, grown: grown > s.least and grown > near)
    packed = pack(parts, "\n\n", lambda size, grown: grown > s.size and size >= s.least)
    return [piece for span in packed for piece in hard_split(span, s)]


SCHEMA = T.ArrayType(
    T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("chunk", T.StringType())])
)


@F.pandas_udf(SCHEMA)
def chunk_list(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in bodies:
        yield pd.Series([[(i, c.first, c.last, c.text) for i, c in enumerate(spans(b or ""))] for b in batch], dtype=object)


def chunk(pages: DataFrame) -> DataFrame:
    """(url, ord, line_start, line_end, title, chunk) of pages (url, title, body)."""
    workers(pages.sparkSession)
    found = pages.select("url", F.coalesce("title", F.lit("")).alias("title"), F.explode(chunk_list("body")).alias("c"))
    return found.select("url", "c.ord", "c.line_start", "c.line_end", "title", "c.chunk")
