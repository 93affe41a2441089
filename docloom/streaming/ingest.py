"""Incremental maintenance: upserts, deletions and the derived tables that follow.

Parquet has no update in place, so a change is a set-wise rewrite: what the
batch replaces is taken out by an anti join, and the new rows are added.  The
same functions serve a batch and a stream (``foreachBatch``).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import schema, validate
from docloom.functions.session import shuffled_joins, workers
from docloom.operators import catalog, chunks, graph
from docloom.operators import index as ix
from docloom.operators.store import Store, cut
from docloom.sources import html


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``; partial aggregation keeps hot keys apart."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def merge(table: DataFrame | None, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with a batch over it; the batch wins whatever the order says of older rows."""
    new = latest(batch, keys, order)
    if table is None:
        return new
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without_source(table: DataFrame, source_base: str) -> DataFrame:
    """A table of a store without a root's rows."""
    return table.where(~F.col("source_base").eqNullSafe(source_base))


def without_pages(table: DataFrame, gone: DataFrame, column: str = "page_url") -> DataFrame:
    """Rows whose page is not among ``gone`` (url)."""
    return table.join(gone.select(F.col("url").alias(column)).distinct(), column, "left_anti").select(table.columns)


def prune_incoming(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges without those into entities that were there and are no more."""
    lost = old.select("entity_id").distinct().join(new.select("entity_id"), "entity_id", "left_anti")
    return edges.join(lost.withColumnRenamed("entity_id", "to_entity_id"), "to_entity_id", "left_anti").select(edges.columns)


def _with_totals(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables and, of each index, its row of totals."""
    return tables | {t.replace("_lengths", "_totals"): ix.totals(rows) for t, rows in tables.items() if t.endswith("_lengths")}


def clear_source(store: Store, source_base: str) -> int:
    """Delete a root: its pages and all that came from them. Returns how many pages went."""
    root = validate.source_base(source_base)
    with shuffled_joins(store.spark):
        return _clear(store, root)


def _clear(store: Store, root: str) -> int:
    pages = store.read("pages")
    gone = cut(pages.where(F.col("source_base") == root).select("url"))
    entities = store.read("entities")
    ids = entities.where(F.col("source_base") == root).select("entity_id")
    changed = {"pages": without_source(pages, root), "chunks": without_pages(store.read("chunks"), gone, "url"), "entities": without_source(entities, root)}
    changed |= {t: store.read(t).join(ids, "entity_id", "left_anti") for t in ("params", "notes", "entity_postings", "entity_lengths")}
    changed |= {t: without_pages(store.read(t), gone, "url") for t in ("chunk_postings", "chunk_lengths")}
    changed |= {t: without_source(store.read(t), root) for t in ("edges", "candidates")}
    # Everything is read before anything is replaced.
    changed = _with_totals({t: cut(schema.conform(rows, t)) for t, rows in changed.items()})
    for t, rows in changed.items():
        store.write(t, rows)
    return gone.count()


def upsert_pages(store: Store, fetched: DataFrame, source_base: str, now: int | None = None) -> None:
    """Write a batch of fetched pages (url, html) and all that follows from them.

    Pages and their chunks, entities, parameters, notes, candidates and index
    entries are replaced; edges from these pages are rebuilt, and edges into entities that
    went are dropped.
    """
    root = validate.source_base(source_base)
    # The batch of a stream has a session of its own.
    with shuffled_joins(store.spark), shuffled_joins(fetched.sparkSession):
        _upsert(store, fetched, root, now or int(time.time()))


def _upsert(store: Store, fetched: DataFrame, root: str, now: int) -> None:
    batch = fetched.groupBy("url").agg(F.max("html").alias("html")) if "seq" not in fetched.columns else latest(fetched, ["url"], "seq")
    parsed = cut(html.parse(batch.select("url", "html")))
    pages = html.page_rows(parsed, root, now)
    found = cut(html.entity_rows(parsed, root))
    params, notes = html.child_tables(found)
    links = graph.link_candidates(found)
    gone = cut(parsed.select("url"))
    workers(store.spark)

    old = store.read("entities")
    old_here = old.join(gone.withColumnRenamed("url", "page_url"), "page_url", "left_semi")
    over = lambda table, new, column="page_url": without_pages(store.read(table), gone, column).unionByName(schema.conform(new, table))
    child = lambda table, new: store.read(table).join(old_here.select("entity_id"), "entity_id", "left_anti").unionByName(schema.conform(new, table))
    entities = cut(without_pages(old, gone).unionByName(schema.conform(found, "entities")))
    stated = graph.text_candidates(found, notes)
    candidates = cut(over("candidates", graph.unique_candidates(links.unionByName(stated))))
    kept = without_pages(store.read("edges"), gone)
    kept = prune_incoming(kept, old_here, found)
    own = entities.where(F.col("source_base") == root)
    mine = own.join(gone.withColumnRenamed("url", "page_url"), "page_url", "left_semi")
    all_params = child("params", params)
    fresh = graph.signature_edges(own, all_params).join(mine.select("page_url").distinct(), "page_url", "left_semi")
    linked = graph.resolved_edges(candidates.where(F.col("source_base") == root), own)
    edges = graph.unique_edges(kept.unionByName(fresh.select(kept.columns)).unionByName(linked.select(kept.columns)))
    cut_up = cut(chunks.chunk(pages))
    by_chunk, by_entity = ix.build(cut_up, ["url", "ord"], ["title", "chunk"]), catalog.entity_index(found, notes)
    tables = {"pages": over("pages", pages, "url"), "chunks": over("chunks", cut_up, "url"), "entities": entities, "params": all_params, "notes": child("notes", notes), "candidates": candidates, "edges": edges}
    tables |= {"chunk_postings": over("chunk_postings", by_chunk.postings, "url"), "chunk_lengths": over("chunk_lengths", by_chunk.lengths, "url")}
    tables |= {"entity_postings": child("entity_postings", by_entity.postings), "entity_lengths": child("entity_lengths", by_entity.lengths)}
    tables = _with_totals({t: cut(schema.conform(rows, t)) if t != "pages" else rows for t, rows in tables.items()})
    pages_now = tables.pop("pages")
    store.write("pages", pages_now)
    for t, rows in tables.items():
        store.write(t, rows)


def rebuild_graph(store: Store, source_base: str) -> None:
    """Resolve all candidates of a root again and replace the edges that came from candidates."""
    root = validate.source_base(source_base)
    with shuffled_joins(store.spark):
        _rebuild(store, root)


def _rebuild(store: Store, root: str) -> None:
    edges, own = store.read("edges"), store.read("entities").where(F.col("source_base") == root)
    stale = (F.col("source_base") == root) & F.col("source_kind").isin("xref", "text_inference")
    again = graph.resolved_edges(store.read("candidates").where(F.col("source_base") == root), own)
    store.write("edges", cut(graph.unique_edges(edges.where(~stale).unionByName(again.select(edges.columns)))))


def stream_pages(store: Store, incoming: DataFrame, source_base: str, checkpoint: str):
    """A streaming query that upserts each micro-batch of fetched pages (url, html)."""
    return incoming.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert_pages(store, batch, source_base)).trigger(availableNow=True)
