"""The engine's tools over a store, as functions that return DataFrames.

Each function checks its parameters, then builds a plan over the store's
tables; nothing is computed until the result is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docloom.functions import validate
from docloom.operators import catalog, graph, search
from docloom.operators import index as ix
from docloom.operators.store import Store
from docloom.sources import crawl
from docloom.streaming import ingest


@dataclass(frozen=True)
class Engine:
    store: Store

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None) -> "Engine":
        return cls(Store(spark, path) if path else Store.default(spark))

    def _t(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _chunk_index(self) -> ix.Index:
        return ix.Index(self._t("chunk_postings"), self._t("chunk_lengths"), ("url", "ord"), ("title", "chunk"), "english", self._t("chunk_totals"))

    def _entity_index(self) -> ix.Index:
        return ix.Index(self._t("entity_postings"), self._t("entity_lengths"), ("entity_id",), (*catalog.SEARCHED, "body"), "english", self._t("entity_totals"))

    # --- indexing ---

    def index_site(self, seed_url: str, fetch: Callable[[DataFrame], DataFrame], max_pages: int = 200, replace_source: bool = True, sitemap: DataFrame | None = None) -> DataFrame:
        """Crawl under the seed's root, write what was fetched, resolve the graph; returns the counters."""
        seed = validate.web_url("seed_url", seed_url)
        if replace_source:
            ingest.clear_source(self.store, seed)
        pages, counters = crawl.crawl(seed, fetch, self.store.spark, max_pages, sitemap)
        if pages is not None:
            ingest.upsert_pages(self.store, pages, seed)
            ingest.rebuild_graph(self.store, seed)
        return counters

    # --- pages ---

    def search(self, query: str, limit: int = 15, source_base: str | None = None) -> DataFrame:
        return search.search(self._chunk_index(), self._t("chunks"), self._t("pages"), query, limit, source_base)

    def search_in_file(self, page_url: str, query: str, limit: int = 15) -> DataFrame:
        return search.search_in_page(self._chunk_index(), self._t("chunks"), self._t("pages"), page_url, query, limit)

    def fetch(self, page_url: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return catalog.fetch_page(self._t("pages"), validate.web_url("id", page_url), start, end)

    def list_documentation_pages(self, source_base: str | None = None, url_contains: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
        return catalog.list_pages(self._t("pages"), source_base, url_contains, limit, offset)

    def list_indexed_sources(self) -> DataFrame:
        return catalog.list_sources(self._t("pages"))

    def index_status(self) -> DataFrame:
        return catalog.status(self._t("pages"))

    # --- symbols ---

    def search_entities(self, query: str, limit: int = 15, kind: str | None = None, source_base: str | None = None) -> DataFrame:
        return catalog.search_entities(self._entity_index(), self._t("entities"), query, limit, kind, source_base)

    def get_entity(self, entity_id: str, include_methods: bool = True) -> DataFrame:
        return catalog.get_entity(self._t("entities"), self._t("params"), self._t("notes"), entity_id, include_methods)

    def list_class_methods(self, class_entity_id: str | None = None, class_name: str | None = None, source_base: str | None = None) -> DataFrame:
        return catalog.class_methods(self._t("entities"), class_entity_id, class_name, validate.source_base(source_base))

    def get_entity_context(self, query: str, kind: str | None = None, source_base: str | None = None) -> DataFrame:
        return catalog.entity_context(self._entity_index(), self._t("entities"), self._t("params"), self._t("notes"), query, kind, source_base)

    def lookup_symbol(self, source_base: str, symbol_name: str, include_related: bool = False) -> DataFrame:
        root = validate.source_base(source_base) or ""
        return catalog.lookup_symbol(self._entity_index(), self._t("entities"), self._t("pages"), self._t("edges"), root, validate.symbol(symbol_name), include_related)

    def related_symbols(self, source_base: str, symbol_name: str, edge_types: list[str] | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
        """Neighbours of a symbol; no rows if it isn't found."""
        entities = self._t("entities")
        first = catalog.find_symbol(self._entity_index(), entities, validate.source_base(source_base) or "", validate.symbol(symbol_name)).first()
        return graph.related(self._t("edges"), entities, first.entity_id if first else "", validate.edge_types(edge_types), direction, limit)

    def symbol_graph_stats(self, source_base: str) -> DataFrame:
        return graph.stats(self._t("pages"), self._t("entities"), self._t("edges"), self._t("candidates"), validate.source_base(source_base) or "")
