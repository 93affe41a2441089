"""Queries that crawl the manual and keep it in a store, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.api import Engine
from docloom.operators.store import shared_folder
from docloom.plans import manual
from docloom.plans.book import query
from docloom.sources import crawl
from docloom.streaming import ingest

_SEED = manual.BASE + "s0.html"


def _crawl(spark: SparkSession, sf_dir: str, most: int) -> tuple[DataFrame, DataFrame]:
    """From the first page; all pages stand in a sitemap, in order."""
    stored = manual.pages(spark, sf_dir).select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "html")
    number = F.regexp_extract("loc", "s([0-9]+)\\.html$", 1).cast("int")
    listed = stored.select(F.col("url").alias("loc")).orderBy(number).coalesce(1)
    return crawl.crawl(_SEED, lambda urls: stored.join(urls, "url", "left_semi"), spark, most, listed)


@query("crawl_manual", f"WITH {manual.SUPPLIERS} SELECT url FROM p WHERE s_suppkey < 20")
def crawl_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty pages that a crawl keeps: the seed, what it links to, then the sitemap."""
    return _crawl(spark, sf_dir, 20)[0].select("url")


@query("crawl_counts", "SELECT least(count(*), 20)::BIGINT AS fetched, 0::BIGINT AS skipped, CASE WHEN count(*) < 20 THEN 4 ELSE 3 END::BIGINT AS errors FROM supplier")
def crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the URLs asked for; three of the seed's links lead nowhere, and of a short manual the last page's link to a next one."""
    return _crawl(spark, sf_dir, 20)[1]


def _kept(spark: SparkSession, sf_dir: str) -> Engine:
    """The manual in a new store: all pages, then those with even numbers again, changed."""
    engine = Engine.open(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    every = manual.pages(spark, sf_dir)
    ingest.upsert_pages(engine.store, every, manual.BASE, 1)
    even = F.regexp_extract("url", "s([0-9]+)\\.html$", 1).cast("int") % 2 == 0
    changed = F.replace(F.replace("html", F.lit("Use lead."), F.lit("New lead.")), F.lit("must be used with"), F.lit("is similar to"))
    ingest.upsert_pages(engine.store, every.where(even).withColumn("html", changed), manual.BASE, 2)
    ingest.rebuild_graph(engine.store, manual.BASE)
    return engine


_CHANGED = f"CASE WHEN s_suppkey % 2 = 0 THEN replace(replace({manual.BODY}, 'Use lead.', 'New lead.'), 'must be used with', 'is similar to') ELSE {manual.BODY} END"


@query("store_chunks", f"WITH {manual.SUPPLIERS} SELECT url, 'Manual of S' || k AS title, 0::INT AS ord, {_CHANGED} AS chunk FROM p")
def store_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a store after a second batch: those of replaced pages are new, the others stay."""
    return _kept(spark, sf_dir).store.read("chunks").select("url", "title", "ord", "chunk")


@query(
    "store_edges",
    f"""WITH {manual.SUPPLIERS}, {manual.OBJECTS}, {manual.EDGES}
SELECT from_entity_id, to_entity_id, CASE WHEN edge_type = 'requires' AND regexp_extract(from_entity_id, 's([0-9]+)[.]html', 1)::INT % 2 = 0 THEN 'similar_to' ELSE edge_type END AS edge_type, source_kind FROM g""",
)
def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a store after a second batch, with those from links and prose resolved again."""
    return _kept(spark, sf_dir).store.read("edges").select("from_entity_id", "to_entity_id", "edge_type", "source_kind")


@query(
    "store_pages",
    f"""WITH {manual.SUPPLIERS} SELECT url, 'Manual of S' || k AS title, '{manual.BASE}' AS source_base, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS fetched_at,
CASE WHEN s_suppkey % 2 = 0 THEN 'New lead.' ELSE 'Use lead.' END AS summary FROM p""",
)
def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a store after a second batch, with a value out of their nested tables of contents."""
    pages = _kept(spark, sf_dir).store.read("pages")
    return pages.select("url", "title", "source_base", "fetched_at", F.expr("variant_get(toc, '$[0].children[0].summary', 'string')").alias("summary"))


@query(
    "store_search",
    f"WITH {manual.SUPPLIERS}, {manual.OBJECTS} SELECT entity_id, qualname, kind FROM o WHERE name = 'S4'",
)
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best class for a name by the store's entity index, built as batches came."""
    return _kept(spark, sf_dir).search_entities("S4", 1, "class", manual.BASE).select("entity_id", "qualname", "kind")
