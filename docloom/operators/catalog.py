"""Listings, point reads, entity search and symbol lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import validate
from docloom.operators import graph
from docloom.operators import index as ix
from docloom.operators import query as q

# --- pages -----------------------------------------------------------------------


def list_sources(pages: DataFrame) -> DataFrame:
    """(source_base, page_count, last_fetched_at) of each root."""
    return pages.groupBy("source_base").agg(F.count("*").alias("page_count"), F.max("fetched_at").alias("last_fetched_at")).orderBy("source_base")


def select_pages(pages: DataFrame, source_base: str | None = None, url_contains: str | None = None) -> DataFrame:
    """Pages of a root whose URL holds a text, case and all."""
    out = pages
    if source_base is not None:
        out = out.where(F.col("source_base") == source_base)
    if url_contains is not None:
        out = out.where(F.contains("url", F.lit(url_contains)))
    return out


def list_pages(pages: DataFrame, source_base: str | None = None, url_contains: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the listing, in order of URL."""
    validate.number("pages_limit", limit)
    validate.number("offset", offset)
    found = select_pages(pages, validate.source_base(source_base), validate.optional_text(url_contains))
    return found.select("url", "title", "source_base", "fetched_at").orderBy("url").offset(offset).limit(limit)


def count_pages(pages: DataFrame, source_base: str | None = None, url_contains: str | None = None) -> DataFrame:
    return select_pages(pages, source_base, url_contains).agg(F.count("*").alias("total"))


def get_page(pages: DataFrame, url: str) -> DataFrame:
    return pages.where(F.col("url") == url)


def fetch_page(pages: DataFrame, url: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row: the page's text, or a slice of its lines; a page that isn't there gives found = false."""
    part = validate.line_slice(start, end)
    whole = F.struct(F.col("body").alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    piece = whole if part is None else tx.line_slice(F.col("body"), *part)
    found = get_page(pages, url).select(F.lit(True).alias("found"), "url", "title", "source_base", "fetched_at", piece.alias("p"), F.size(tx.lines(F.col("body"))).alias("total_lines"))
    found = found.select("found", "url", "title", "source_base", "fetched_at", "p.text", "p.start", "p.end", "total_lines")
    asked = pages.sparkSession.createDataFrame([(url,)], "url string")
    return asked.join(found, "url", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def status(pages: DataFrame) -> DataFrame:
    """The listing of roots as one JSON text."""
    rows = F.collect_list(F.struct("source_base", "page_count", "last_fetched_at"))
    return list_sources(pages).agg(F.to_json(F.struct(F.sort_array(rows).alias("sources"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"))).alias("json"))


# --- entities --------------------------------------------------------------------------

SEARCHED = ["name", "qualname", "signature", "summary"]


def entity_rows(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """What the entity index covers: the searched columns, and the body with its notes, which only adds length."""
    grouped = notes.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "version", "text"))).alias("__notes"))
    rows = entities.join(grouped, "entity_id", "left")
    none = F.array().cast("array<struct<ord int, kind string, version string, text string>>")
    return rows.select("entity_id", *SEARCHED, tx.entity_body(F.col("body_text"), F.coalesce("__notes", none)).alias("body"))


def entity_index(entities: DataFrame, notes: DataFrame, analyzer: str = "english") -> ix.Index:
    return ix.build(entity_rows(entities, notes), ["entity_id"], [*SEARCHED, "body"], analyzer)


def search_entities(index: ix.Index, entities: DataFrame, query: str, limit: int = 15, kind: str | None = None, source_base: str | None = None) -> DataFrame:
    """Best entities for a query, over names, signatures and summaries."""
    validate.number("limit", limit)
    kind, source_base = validate.kind(kind), validate.source_base(source_base)
    scope = entities
    if kind is not None:
        scope = scope.where(F.col("kind") == kind)
    if source_base is not None:
        scope = scope.where(F.col("source_base") == source_base)
    plan = ix.Plan.of(q.stages(query), index.analyzer)
    if not plan.terms:
        return entities.limit(0).withColumn("rank", F.lit(0.0))
    narrowed = scope.select("entity_id") if scope is not entities else None
    hits = ix.match(ix.look_up(index, plan, SEARCHED), plan, narrowed)
    return hits.drop("stage").join(entities, "entity_id").orderBy("rank", "qualname", "entity_id").limit(limit)


def entity_detail(entities: DataFrame, params: DataFrame, notes: DataFrame, methods: bool = True) -> DataFrame:
    """Entities with their parameters, notes and, for classes, methods, as sorted arrays."""
    p = params.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "type", "default_value", "description"))).alias("params"))
    n = notes.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "version", "text"))).alias("notes"))
    full = entities.join(p, "entity_id", "left").join(n, "entity_id", "left")
    for c in ("params", "notes"):
        full = full.withColumn(c, F.coalesce(c, F.array().cast(full.schema[c].dataType)))
    if not methods:
        return full
    child = full.where("kind = 'method'").select(F.col("parent_entity_id").alias("__parent"), F.struct("name", "signature", "entity_id", "qualname", "summary", "params", "notes").alias("m"))
    held = child.groupBy("__parent").agg(F.array_sort(F.collect_list("m")).alias("methods"))
    out = full.join(held, full.entity_id == held["__parent"], "left").drop("__parent")
    return out.withColumn("methods", F.coalesce("methods", F.array().cast(out.schema["methods"].dataType)))


def get_entity(entities: DataFrame, params: DataFrame, notes: DataFrame, entity_id: str, methods: bool = True) -> DataFrame:
    """One entity's detail; its tables are narrowed before they are joined."""
    near = entities.where((F.col("entity_id") == entity_id) | (F.col("parent_entity_id") == entity_id))
    return entity_detail(near, params, notes, methods).where(F.col("entity_id") == entity_id)


def find_class(entities: DataFrame, name: str, source_base: str | None = None) -> DataFrame:
    """The class of a name with the shortest qualified name."""
    found = entities.where((F.col("kind") == "class") & ((F.col("name") == name) | (F.col("qualname") == name)))
    if source_base is not None:
        found = found.where(F.col("source_base") == source_base)
    return found.orderBy(F.length("qualname"), "qualname", "entity_id").limit(1)


def class_methods(entities: DataFrame, class_entity_id: str | None = None, class_name: str | None = None, source_base: str | None = None) -> DataFrame:
    """Methods of a class, by its id or its name."""
    methods = entities.where("kind = 'method'")
    if class_entity_id is not None:
        found = methods.where(F.col("parent_entity_id") == class_entity_id)
    else:
        owner = find_class(entities, class_name or "", source_base).select(F.col("entity_id").alias("parent_entity_id"))
        found = methods.join(owner, "parent_entity_id", "left_semi")
    return found.select(entities.columns).orderBy("name", "signature", "entity_id")


def entity_context(index: ix.Index, entities: DataFrame, params: DataFrame, notes: DataFrame, query: str, kind: str | None = None, source_base: str | None = None) -> DataFrame:
    """Detail, without methods, of the best entity for a query."""
    top = search_entities(index, entities, query, 1, kind, source_base).select(entities.columns)
    return entity_detail(top, params, notes, methods=False)


def _tier(symbol: Column) -> Column:
    return F.when(F.col("qualname") == symbol, 0).when(F.col("anchor") == symbol, 1).when(F.col("name") == symbol, 2)


def find_symbol(index: ix.Index | None, entities: DataFrame, source_base: str, symbol: str) -> DataFrame:
    """At most one entity: by qualified name, anchor or name in turn, shortest first; else the best of a search."""
    symbol = validate.symbol(symbol)
    own = entities.where(F.col("source_base") == source_base)
    exact = own.withColumn("__tier", _tier(F.lit(symbol))).where("__tier is not null")
    exact = exact.orderBy("__tier", F.length("qualname"), "qualname", "entity_id").limit(1).drop("__tier")
    if index is None or not exact.isEmpty():
        return exact
    return search_entities(index, entities, symbol, 1, source_base=source_base).select(entities.columns)


def lookup_symbols(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (source_base, symbol) of ``wanted`` its best exact match: the batch form of the tiers."""
    keys = F.array(
        F.struct(F.lit(0).alias("tier"), F.col("qualname").alias("symbol")),
        F.struct(F.lit(1).alias("tier"), F.col("anchor").alias("symbol")),
        F.struct(F.lit(2).alias("tier"), F.col("name").alias("symbol")),
    )
    named = entities.select("source_base", "entity_id", "qualname", F.explode(keys).alias("k")).select("source_base", "k.symbol", "k.tier", "qualname", "entity_id")
    best = F.min(F.struct("tier", F.length("qualname").alias("size"), "qualname", "entity_id"))
    hit = wanted.distinct().join(named, ["source_base", "symbol"]).groupBy("source_base", "symbol").agg(best.alias("b"))
    return hit.select("source_base", "symbol", "b.tier", "b.qualname", "b.entity_id")


def lookup_symbol(index: ix.Index | None, entities: DataFrame, pages: DataFrame, edges: DataFrame | None, source_base: str, symbol: str, related: bool = False) -> DataFrame:
    """One row: the symbol with its lines of context, or found = false; ``related`` adds its neighbours in words."""
    found = find_symbol(index, entities, source_base, symbol)
    bodies = pages.select(F.col("url").alias("page_url"), F.col("body").alias("__body"))
    row = found.join(bodies, "page_url", "left")
    spare = F.coalesce(F.nullif("body_text", F.lit("")), F.col("summary"), F.lit(""))
    row = row.withColumn("c", tx.context(F.col("__body"), F.col("line_start"), F.col("line_end"), spare))
    link = F.when(F.coalesce("anchor", F.lit("")) != "", F.concat_ws("#", "page_url", "anchor")).otherwise(F.col("page_url"))
    out = row.select(
        F.lit(True).alias("found"), F.coalesce(F.nullif("qualname", F.lit("")), F.col("name")).alias("symbol_name"), "page_url", "anchor", link.alias("url_with_anchor"),
        "kind", "name", "qualname", "line_start", "line_end", F.col("c.start").alias("context_start"), F.col("c.end").alias("context_end"), F.col("c.text").alias("context"), "summary", "entity_id",
    )
    if related and edges is not None and (first := out.select("entity_id").first()):
        # Two rows at most, of thirty texts at most.
        near = {r.direction: r.relations for r in graph.compact_related(edges, entities, first.entity_id).collect()}
        said = [x for k, v in near.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
        out = out.withColumn("related", F.create_map(*said) if said else F.lit(None).cast("map<string,array<string>>"))
    asked = pages.sparkSession.createDataFrame([(1, symbol.strip())], "one int, asked string")
    joined = asked.join(out.withColumn("one", F.lit(1)), "one", "left").drop("one")
    return joined.withColumn("symbol_name", F.coalesce("symbol_name", "asked")).withColumn("found", F.coalesce("found", F.lit(False))).drop("asked")
