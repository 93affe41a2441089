"""Crawling as tables: links of pages, a breadth-first frontier, sitemaps.

Fetching is the caller's: a function from a frontier of URLs to pages.  The
default reads pages that are there already, so a crawl can be replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import urls
from docloom.functions.session import workers

_ANCHOR = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"'>]*)["']"""
_RELATED = r"""(?i)<link\s[^>]*>"""


def page_links(pages: DataFrame) -> DataFrame:
    """Pages with ``pos`` and ``href``: anchors in order, then link elements of a page relation."""
    anchors = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1))
    heads = F.filter(F.regexp_extract_all("html", F.lit(_RELATED), F.lit(0)), lambda x: x.rlike(f"(?i)\\srel\\s*=\\s*[\"']?(?:[^\"'>]*\\s)?({'|'.join(urls.PAGE_RELATIONS)})(?=[\\s\"'>/])") & x.rlike("(?i)\\shref\\s*="))
    hrefs = F.transform(heads, lambda x: F.regexp_extract(x, r"""(?i)\shref\s*=\s*["']?([^"'\s>]*)""", 1))
    return pages.select("*", F.posexplode(F.concat(anchors, hrefs)).alias("pos", "href"))


def same_site_links(pages: DataFrame, site: Column, prefix: Column) -> DataFrame:
    """Pages' links, made absolute, that stay under a path of a site and look like pages: adds ``link`` and ``pos``."""
    workers(pages.sparkSession)
    found = page_links(pages.withColumns({"__site": site, "__prefix": prefix}))
    unescaped = F.replace("href", F.lit("&amp;"), F.lit("&"))
    found = found.withColumn("link", urls.page_url(urls.join(F.col("url"), unescaped)))
    link = F.col("link")
    return found.where(link.isNotNull() & urls.is_page(link) & urls.under_prefix(link, F.col("__site"), F.col("__prefix"))).drop("__site", "__prefix", "html")


def frontier(links: DataFrame, start: int | str, max_depth: int | None = None, max_pages: int | None = None) -> DataFrame:
    """(page, depth, found_at) in breadth-first order from a start over links (page, target, pos).

    Each round joins the newest pages to their links, leaves out those met
    before, and keeps of each new page its first sighting: by the place of the
    page that links to it, then by the link's place there.  Rounds go on until
    one meets no new page, or to ``max_depth`` if it is given.  The loop holds
    two numbers on the driver; its tables are checkpointed.
    """
    from docloom.operators.store import cut

    spark = links.sparkSession
    kind = links.schema["page"].dataType.simpleString()
    seen = spark.createDataFrame([(start, 0, 0)], f"page {kind}, depth int, found_at long")
    newest, total, depth = seen, 1, 0
    while (max_depth is None or depth < max_depth) and (max_pages is None or total < max_pages):
        depth += 1
        met = newest.select("page", "found_at").join(links, "page").select(F.col("target").alias("page"), F.struct("found_at", "pos").alias("by"))
        fresh = met.groupBy("page").agg(F.min("by").alias("by")).join(seen.select("page"), "page", "left_anti")
        # Numbers that grow in breadth-first order, without gathering a round in one task.
        fresh = fresh.orderBy("by", "page").withColumn("found_at", F.monotonically_increasing_id()).withColumn("depth", F.lit(depth))
        newest = cut(fresh.select("page", "depth", "found_at"))
        n = newest.count()
        if not n:
            break
        total += n
        seen = cut(seen.unionByName(newest))
    return seen if max_pages is None else seen.orderBy("depth", "found_at").limit(max_pages)


_PLACE = ["round", "at"]


def crawl(
    seed: str, fetch: Callable[[DataFrame], DataFrame], spark, max_pages: int = 200, sitemap: DataFrame | None = None, max_requests: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(pages, counters) of a breadth-first crawl under the seed's root.

    ``fetch`` takes a table of URLs and returns (url, status, content_type,
    html); what is missing from it counts as an error.  Only HTML that stays
    under the root is kept.  ``sitemap`` (loc, in order) joins the queue after
    the links of the first page.

    The queue is first in, first out: new links go to its end, by the place of
    the page that has them and then by theirs on it.  A round takes as many
    URLs from its front as pages are still wanted, which is what taking them
    one at a time would take.  At most ``max_requests`` URLs are asked for; by
    default 600 for each page wanted, or 2,000 more than the sitemap has, and
    25,000 in all.
    """
    from docloom.functions import validate
    from docloom.operators.store import cut

    validate.web_url("seed_url", seed)
    validate.number("max_pages", max_pages)
    root = validate.source_base(seed)
    site, prefix = root.split("/", 3)[0] + "//" + root.split("/", 3)[2], "/" + root.split("/", 3)[3]
    if max_requests is None:
        max_requests = min(25_000, max((sitemap.count() if sitemap is not None else 0) + 2000, 600 * max_pages))

    def under(column: Column) -> Column:
        return urls.under_prefix(column, F.lit(site), F.lit(prefix))

    queue = spark.createDataFrame([(seed, 0, 0)], "url string, round int, at long").withColumn("url", urls.canonical(F.col("url")))
    visited = spark.createDataFrame([], "url string")
    kept, counts, asked, number = None, {"fetched": 0, "skipped": 0, "errors": 0}, 0, 0
    while counts["fetched"] < max_pages and asked < max_requests:
        batch = cut(queue.orderBy(*_PLACE).limit(min(max_pages - counts["fetched"], max_requests - asked)))
        if not (n := batch.count()):
            break
        asked, number = asked + n, number + 1
        visited = cut(visited.unionByName(batch.select("url")))
        got = batch.join(fetch(batch.select("url")), "url", "left")
        page = F.lower(F.coalesce("content_type", F.lit(""))).contains("text/html") | F.col("url").rlike(r"(\.html|/)$")
        state = F.when(F.col("status").isNull() | (F.col("status") >= 400), "errors").when(page & under(F.col("url")), "fetched").otherwise("skipped")
        got = cut(got.withColumn("state", state))
        for r in got.groupBy("state").count().collect():
            counts[r.state] += r["count"]
        good = got.where("state = 'fetched'")
        kept = good.select("url", "html", *_PLACE) if kept is None else kept.unionByName(good.select("url", "html", *_PLACE))
        found = same_site_links(good.select("url", "html", *_PLACE), F.lit(site), F.lit(prefix))
        met = found.select(urls.canonical(F.col("link")).alias("url"), F.struct(F.lit(0).alias("map"), F.col("round"), F.col("at"), F.col("pos").cast("long").alias("pos")).alias("by"))
        if number == 1 and sitemap is not None:
            listed = sitemap.withColumn("__no", F.monotonically_increasing_id()).where(under(F.col("loc")))
            by = F.struct(F.lit(1).alias("map"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("at"), F.col("__no").alias("pos"))
            met = met.unionByName(listed.select(urls.canonical(F.col("loc")).alias("url"), by.alias("by")))
        waiting = queue.join(visited, "url", "left_anti")
        fresh = met.groupBy("url").agg(F.min("by").alias("by")).join(visited, "url", "left_anti").join(waiting.select("url"), "url", "left_anti")
        fresh = fresh.orderBy("by", "url").select("url", F.lit(number).alias("round"), F.monotonically_increasing_id().alias("at"))
        queue = cut(waiting.unionByName(fresh))
    if kept is None:
        kept = spark.createDataFrame([], "url string, html string, round int, at long")
    kept = kept.orderBy(*_PLACE).select("url", "html")
    return kept, spark.createDataFrame([(counts["fetched"], counts["skipped"], counts["errors"])], "fetched long, skipped long, errors long")


_LOCATIONS = T.ArrayType(T.StructType([T.StructField("loc", T.StringType()), T.StructField("nested", T.BooleanType())]))


def locations(xml: str | bytes | None) -> list[tuple[str, bool]]:
    """(location, whether of a sitemap index) of a sitemap; none of malformed XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    local = lambda el: el.tag.rpartition("}")[2].lower()
    return [(t, local(root) == "sitemapindex") for el in root.iter() if local(el) == "loc" and (t := (el.text or "").strip())]


@F.pandas_udf(_LOCATIONS)
def _location_list(xml: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in xml:
        yield pd.Series([locations(x) for x in batch], dtype=object)


def sitemap_locations(maps: DataFrame, column: str) -> DataFrame:
    """Sitemaps with ``loc`` and ``nested`` (true: the location is a further sitemap)."""
    workers(maps.sparkSession)
    return maps.select("*", F.explode(_location_list(column)).alias("l")).select("*", "l.loc", "l.nested").drop("l", column)


def sitemap_seeds(maps: DataFrame, site: str, prefix: str, max_urls: int) -> DataFrame:
    """Distinct page locations under a path of a site, in order of map and place, at most ``max_urls``."""
    found = sitemap_locations(maps.withColumn("__no", F.monotonically_increasing_id()), "xml").where("not nested")
    page = urls.page_url(F.col("loc"))
    found = found.select("__no", page.alias("loc"), urls.canonical(page).alias("key")).where(urls.under_prefix(F.col("loc"), F.lit(site), F.lit(prefix)))
    best = Window.partitionBy("key").orderBy("__no", "loc")
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").orderBy("__no", "loc").limit(max_urls).select("loc")
