"""URL functions as Column expressions.

A URL is taken apart once by regular expression (scheme, authority, path,
query), so that odd input stays a value and never raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"

#: File endings that are no pages.
SKIPPED_ENDINGS = "pdf zip tar gz png jpg jpeg gif svg ico woff woff2 ttf eot mp4 webm js css".split()
#: Relations of link elements that lead to pages.
PAGE_RELATIONS = "next prev up chapter first last index appendix help contents toc start top subsection section bookmark".split()


def part(url: Column, number: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where there is none."""
    return F.regexp_extract(url, _URL, number)


def origin(url: Column) -> Column:
    return F.concat(F.lower(part(url, 1)), F.lit("://"), part(url, 2))


def path(url: Column) -> Column:
    p = part(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def doc_root(url: Column) -> Column:
    """The directory of a documentation URL, with a final slash; a last segment with a dot is a file."""
    u = F.trim(url)
    p = path(u)
    last = F.substring_index(p, "/", -1)
    folder = F.when(p.endswith("/"), p).when(last.contains("."), F.regexp_replace(p, "[^/]*$", "")).otherwise(F.concat(p, F.lit("/")))
    return F.concat(origin(u), folder)


def page_url(url: Column) -> Column:
    """Without fragment; an empty path becomes /."""
    q = part(url, 4)
    return F.concat(origin(url), path(url), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def _reencoded(query: Column) -> Column:
    """The query without highlight keys; names and values decoded and encoded again."""
    pairs = F.filter(F.split(query, "&"), lambda x: (x != "") & (F.lower(F.url_decode(F.substring_index(x, "=", 1))) != "highlight"))

    def again(x: Column) -> Column:
        key = F.substring_index(x, "=", 1)
        value = F.when(x.contains("="), F.substring(x, F.length(key) + 2, F.lit(1 << 30))).otherwise(F.lit(""))
        encode = lambda v: F.replace(F.replace(F.url_encode(F.url_decode(v)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        return F.concat(encode(key), F.lit("="), encode(value))

    return F.array_join(F.transform(pairs, again), "&")


def canonical(url: Column) -> Column:
    """One spelling for each page: no fragment, no highlight keys, index.html as its directory."""
    q = _reencoded(part(url, 4))
    folder = F.regexp_replace(path(url), "(?i)/index\\.html$", "/")
    return F.concat(origin(url), folder, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def under_prefix(url: Column, site: Column, prefix: Column) -> Column:
    """Whether a page is at or below a path of a site."""
    base = F.regexp_replace(prefix, "/+$", "")
    p = F.regexp_replace(path(url), "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    return (origin(url) == site) & ((p == base) | p.startswith(F.concat(base, F.lit("/"))))


def is_page(url: Column) -> Column:
    """Web URLs that don't end like a file of another kind."""
    return F.lower(part(url, 1)).isin("http", "https") & ~url.rlike(f"(?i)\\.({'|'.join(SKIPPED_ENDINGS)})$")


@F.pandas_udf(T.StringType())
def join(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A link resolved against the page it stands on (RFC 3986)."""

    def one(base: str | None, href: str | None) -> str | None:
        if base is None or href is None:
            return None
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    for base, href in pairs:
        yield pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def fragment(url: Column) -> Column:
    return F.trim(F.when(url.contains("#"), F.regexp_extract(url, "#(.*)$", 1)).otherwise(F.lit("")))
