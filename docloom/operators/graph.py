"""The symbol graph: edges from structure, signatures, links and prose; resolution; neighbours; diagnostics.

Edges are built for all pages at once and resolve against all entities of
their root, so the result does not depend on the order of pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import schema
from docloom.functions import text as tx
from docloom.functions.session import workers

# --- names -------------------------------------------------------------------


def names_by_qualname(entities: DataFrame) -> DataFrame:
    """(source_base, key, entity_id): of equal qualified names the greatest id."""
    named = entities.where(F.coalesce("qualname", F.lit("")) != "")
    return named.groupBy("source_base", F.col("qualname").alias("key")).agg(F.max("entity_id").alias("entity_id"))


def unique_names(entities: DataFrame, qualified: bool = True) -> DataFrame:
    """(source_base, key, entity_id) of simple names that occur once; ``qualified``: only entities with a qualified name count."""
    named = entities.where(F.coalesce("name", F.lit("")) != "")
    if qualified:
        named = named.where(F.coalesce("qualname", F.lit("")) != "")
    found = named.groupBy("source_base", F.col("name").alias("key")).agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"))
    return found.where("n = 1").drop("n")


def resolve(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Add ``target`` to refs (source_base, current, symbol, ...): the entity that a name means, rows without one dropped.

    Tried in turn: the qualified name, a simple name that occurs once, and the
    name under the enclosing prefixes of ``current``, longest first.
    """
    numbered = refs.withColumn("__ref", F.monotonically_increasing_id())
    symbol = tx.strip(F.col("symbol"))
    exact = F.array(F.struct(F.lit(0).alias("tier"), F.lit("q").alias("map"), symbol.alias("key")), F.struct(F.lit(1).alias("tier"), F.lit("n").alias("map"), symbol.alias("key")))
    outer = F.transform(tx.relative_qualnames(F.col("current"), symbol), lambda x, i: F.struct((i + 2).alias("tier"), F.lit("q").alias("map"), x.alias("key")))
    tried = numbered.where((symbol != "") & ~tx.is_ignored_type(symbol)).select("*", F.explode(F.concat(exact, outer)).alias("t"))
    maps = names_by_qualname(entities).withColumn("map", F.lit("q")).unionByName(unique_names(entities).withColumn("map", F.lit("n")))
    maps = maps.withColumnRenamed("entity_id", "target")
    hit = tried.select("*", "t.tier", "t.map", "t.key").drop("t").join(maps, ["source_base", "map", "key"])
    best = hit.groupBy("__ref", *refs.columns).agg(F.min(F.struct("tier", "target")).alias("best"))
    return best.select(*refs.columns, F.col("best.target").alias("target"))


# --- edges of structure and signatures -------------------------------------------


def has_method(entities: DataFrame) -> DataFrame:
    found = entities.where((F.col("kind") == "method") & (F.coalesce("parent_entity_id", F.lit("")) != ""))
    return schema.conform(
        found.select("source_base", F.col("parent_entity_id").alias("from_entity_id"), F.col("entity_id").alias("to_entity_id"), F.lit("has_method").alias("edge_type"), F.lit("structure").alias("source_kind"), "page_url", "line_start", "line_end"),
        "edges",
    )


def _typed(entities: DataFrame, refs: DataFrame, edge_type: str) -> DataFrame:
    """Signature edges of refs (entity columns, type_text, param_name)."""
    each = refs.select("source_base", "entity_id", "page_url", "line_start", "line_end", F.col("qualname").alias("current"), "type_text", "param_name", F.explode(tx.type_names(F.col("type_text"))).alias("symbol"))
    found = resolve(each, entities)
    return schema.conform(
        found.select("source_base", F.col("entity_id").alias("from_entity_id"), F.col("target").alias("to_entity_id"), F.lit(edge_type).alias("edge_type"), F.lit("signature").alias("source_kind"), "param_name", F.col("type_text").alias("snippet"), "page_url", "line_start", "line_end"),
        "edges",
    )


def returns(entities: DataFrame) -> DataFrame:
    refs = entities.select("*", tx.return_annotation(F.col("signature")).alias("type_text"), F.lit("").alias("param_name"))
    return _typed(entities, refs, "returns")


def inherits_from(entities: DataFrame) -> DataFrame:
    refs = entities.where("kind = 'class'").select("*", tx.base_annotation(F.col("signature")).alias("type_text"), F.lit("").alias("param_name"))
    return _typed(entities, refs, "inherits_from")


def accepts_parameter_type(entities: DataFrame, params: DataFrame) -> DataFrame:
    mine = params.select("entity_id", F.col("name").alias("param_name"), F.col("type").alias("type_text"))
    return _typed(entities, entities.join(mine, "entity_id"), "accepts_parameter_type")


def signature_edges(entities: DataFrame, params: DataFrame) -> DataFrame:
    """All edges of structure and signatures, each once."""
    parts = [has_method(entities), returns(entities), inherits_from(entities), accepts_parameter_type(entities, params)]
    return unique_edges(reduce(DataFrame.unionByName, parts))


# --- candidates -------------------------------------------------------------------

#: Phrases of prose that state a relation, how sure it is, and names that follow from_.
RELATIONS = (
    ("only_valid_in", r"\bcan only be used in ([A-Z][A-Za-z0-9_.]*)\b", 0.7),
    ("requires", r"\bmust be used with ([A-Z][A-Za-z0-9_.]*)\b", 0.7),
    ("use_instead", r"\buse ([A-Z][A-Za-z0-9_.]*) instead\b", 0.75),
    ("similar_to", r"\bsimilar to ([A-Z][A-Za-z0-9_.]*)\b", 0.65),
    ("converts_to", r"\bconverted to ([A-Z][A-Za-z0-9_.]*)\b", 0.7),
)
FROM_NAME = r"\bfrom_([A-Za-z_][A-Za-z0-9_]*)\b"
FROM_CONFIDENCE = 0.6

_MENTION = T.ArrayType(
    T.StructType([T.StructField("edge_type", T.StringType()), T.StructField("target_name", T.StringType()), T.StructField("snippet", T.StringType()), T.StructField("confidence", T.DoubleType())])
)


def sentence(text: str, start: int, end: int, most: int = 300) -> str:
    """The sentence around a match: up to the full stops or line ends beside it."""
    left = max(text.rfind(stop, 0, start) for stop in ".\n")
    stops = [at for at in (text.find(stop, end) for stop in ".\n") if at >= 0]
    right = min(stops, default=min(len(text), end + 120))
    return text[left + 1 : right + 1].strip()[:most]


def mentions(text: str) -> list[tuple[str, str, str, float]]:
    """(edge type, name, sentence, confidence) of relations that a text states. Case is ignored throughout."""
    found = []
    for edge_type, pattern, confidence in RELATIONS:
        for m in re.finditer(pattern, text, re.I):
            found.append((edge_type, m[1].strip(".,;:)"), sentence(text, *m.span()), confidence))
    for m in re.finditer(FROM_NAME, text):
        if m[1].strip("_"):
            name = "".join(w.capitalize() for w in m[1].split("_"))
            found.append(("converts_to", name, sentence(text, *m.span()), FROM_CONFIDENCE))
    return found


#: A text in which any relation can be stated.
_STATED = "|".join([f"(?i:{pattern})" for _, pattern, _ in RELATIONS] + [FROM_NAME])


@F.pandas_udf(_MENTION)
def mention_list(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([mentions(t) if t else [] for t in batch], dtype=object)


def text_candidates(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """Candidates that the texts and notes of entities state in words."""
    workers(entities.sparkSession)
    place = ["source_base", "page_url", "entity_id", "line_start", "line_end"]
    number = F.col("ord") if "ord" in notes.columns else F.lit(0)
    own = entities.select(*place, F.lit(-1).alias("part"), F.col("body_text").alias("text"))
    noted = entities.select(*place).join(notes.select("entity_id", number.cast("int").alias("part"), "text"), "entity_id")
    # A pattern in the JVM finds the texts that state anything; Python sees those alone.
    some = own.unionByName(noted).where(F.col("text").rlike(_STATED))
    each = some.select("*", F.posexplode(mention_list("text")).alias("at", "m"))
    found = each.select("source_base", "page_url", F.col("entity_id").alias("from_entity_id"), F.lit("text_inference").alias("source_kind"), "line_start", "line_end", "m.*", "part", "at")
    return unique_candidates(schema.conform(found, "candidates", ["part", "at"]), ["part", "at"])


def link_candidates(entities: DataFrame) -> DataFrame:
    """Candidates from the links of entities with an array ``xrefs``, the first of equals; a confidence of 0 or null is 1."""
    each = entities.select("source_base", "page_url", F.col("entity_id").alias("from_entity_id"), "line_start", "line_end", F.posexplode("xrefs").alias("at", "x"))
    text = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c)
    sure = F.coalesce(F.nullif(F.col("x.confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence")
    kind = F.coalesce(F.nullif(F.col("x.source_kind"), F.lit("")), F.lit("xref")).alias("source_kind")
    cols = [text(c) for c in ("edge_type", "target_url", "target_anchor", "target_name", "snippet")]
    found = each.select("source_base", "page_url", "from_entity_id", "line_start", "line_end", kind, sure, *cols, "at")
    return unique_candidates(schema.conform(found, "candidates", ["at"]), ["at"])


def _first_of(rows: DataFrame, key: list[str], order: list[str] | None) -> DataFrame:
    """One row for each key: the first by the columns of ``order``, which are dropped; without them the surest, then the greatest of the other columns."""
    others = [c for c in rows.columns if c not in key and c not in (order or [])]
    if order:
        kept = F.min_by(F.struct(*others), F.struct(*order))
    else:
        kept = F.max(F.struct(*sorted(others, key=lambda c: c != "confidence")))
    chosen = rows.groupBy(*key).agg(kept.alias("__r"))
    return chosen.select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in rows.columns if c in key or c in others])


def unique_edges(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Edges, each once. ``order`` names columns by which the first of equal keys stays."""
    return _first_of(edges, schema.EDGE_KEY, order)


def unique_candidates(candidates: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Candidates, each once. ``order`` names columns by which the first of equal keys stays."""
    return _first_of(candidates, schema.CANDIDATE_KEY, order)


# --- resolution --------------------------------------------------------------------


def resolved_pairs(candidates: DataFrame, entities: DataFrame, key: str = "cid") -> DataFrame:
    """Distinct (key, entity_id): by anchor alone, by page and anchor, by qualified name, by a name that occurs once.

    The alternatives are equi-joins, united; a candidate may have several.
    """
    c = candidates.select(key, "source_base", *[F.coalesce(x, F.lit("")).alias(x) for x in ("target_url", "target_anchor", "target_name")])
    e = entities.select("source_base", "entity_id", "page_url", "anchor", "qualname")
    anchored, named = c.where("target_anchor != ''"), c.where("target_name != ''")
    by_anchor = anchored.where("target_url = ''").join(e.withColumnRenamed("anchor", "target_anchor"), ["source_base", "target_anchor"])
    by_page = anchored.where("target_url != ''").join(e.withColumnsRenamed({"anchor": "target_anchor", "page_url": "target_url"}), ["source_base", "target_url", "target_anchor"])
    by_qualname = named.join(e.withColumnRenamed("qualname", "target_name"), ["source_base", "target_name"])
    by_name = named.join(unique_names(entities, qualified=False).withColumnRenamed("key", "target_name"), ["source_base", "target_name"])
    return reduce(DataFrame.unionByName, [p.select(key, "entity_id") for p in (by_anchor, by_page, by_qualname, by_name)]).distinct()


def resolved_edges(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of all candidates that resolve, each once."""
    keyed = candidates.withColumn("cid", F.struct(*schema.CANDIDATE_KEY, "source_base", "page_url"))
    # A struct of texts as key: null line numbers are made comparable first.
    keyed = keyed.withColumn("cid", F.to_json("cid"))
    pairs = resolved_pairs(keyed, entities)
    found = keyed.join(pairs, "cid").withColumnRenamed("entity_id", "to_entity_id").withColumn("param_name", F.lit(""))
    return unique_edges(schema.conform(found, "edges"))


def unresolved(candidates: DataFrame, entities: DataFrame, key: str = "cid") -> DataFrame:
    """Candidates that resolve to nothing."""
    return candidates.join(resolved_pairs(candidates, entities, key).select(key).distinct(), key, "left_anti")


def stale_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which an end does not exist."""
    ids = entities.select("entity_id").distinct()
    from_ids = ids.select(F.col("entity_id").alias("from_entity_id"), F.lit(True).alias("__from"))
    to_ids = ids.select(F.col("entity_id").alias("to_entity_id"), F.lit(True).alias("__to"))
    found = edges.join(from_ids, "from_entity_id", "left").join(to_ids, "to_entity_id", "left")
    return found.where("__from is null or __to is null").select(edges.columns)


def build(entities: DataFrame, params: DataFrame, notes: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, candidates) of all entities; ``candidates`` are those of links."""
    stated = text_candidates(entities, notes)
    every = stated if candidates is None else unique_candidates(candidates.unionByName(stated))
    return unique_edges(signature_edges(entities, params).unionByName(resolved_edges(every, entities))), every


# --- neighbours ----------------------------------------------------------------------

EDGE_ORDER = ["edge_type", "source_kind", "to_entity_id", "from_entity_id", "param_name", "page_url", "line_start", "line_end"]


def neighbours(edges: DataFrame, entity_id: str, direction: str = "out", edge_type: str | None = None, limit: int = 50) -> DataFrame:
    """Edges out of or into an entity, in a fixed order; the limit is kept within 1 and 500."""
    end = {"out": "from_entity_id", "in": "to_entity_id"}[direction]
    found = edges.where(F.col(end) == entity_id)
    if edge_type is not None:
        found = found.where(F.col("edge_type") == edge_type)
    return found.orderBy(*EDGE_ORDER).limit(max(1, min(limit, 500)))


def edges_between(edges: DataFrame, from_id: str, to_id: str) -> DataFrame:
    return edges.where((F.col("from_entity_id") == from_id) & (F.col("to_entity_id") == to_id)).orderBy(*EDGE_ORDER)


def relation_label(edge_type: Column, direction: Column) -> Column:
    """The edge type, read from the other end for edges into the symbol."""
    inverse = {"returns": "returned_by", "accepts_parameter_type": "used_by", "has_method": "method_of"}
    seen = reduce(lambda c, kv: F.when(edge_type == kv[0], F.lit(kv[1])).otherwise(c), inverse.items(), edge_type)
    return F.when(direction == "in", seen).otherwise(edge_type)


def _quota(edges: DataFrame, entity_id: Column, edge_types: list[str] | None, directions: list[str], limit: int) -> DataFrame:
    """Edges of an entity under one limit: out before in, type by type in the order asked for."""
    parts = []
    for d, direction in enumerate(directions):
        end = "from_entity_id" if direction == "out" else "to_entity_id"
        turn = F.lit(0) if edge_types is None else F.array_position(F.array(*map(F.lit, edge_types)), F.col("edge_type")).cast("int")
        found = edges.where(F.col(end) == entity_id).withColumns({"direction": F.lit(direction), "__d": F.lit(d), "__turn": turn})
        parts.append(found if edge_types is None else found.where(F.col("edge_type").isin(edge_types)))
    order = ["__d", "__turn", *EDGE_ORDER]
    top = reduce(DataFrame.unionByName, parts).orderBy(*order).limit(limit)
    return top.withColumn("__at", F.row_number().over(Window.orderBy(*order)))


def _sorted_key() -> list[Column]:
    rank = reduce(lambda c, kv: F.when(F.col("source_kind") == kv[0], kv[1]).otherwise(c), {"structure": 0, "signature": 0, "xref": 1, "text_inference": 2}.items(), F.lit(9))
    other = F.when(F.col("direction") == "out", F.col("to_entity_id")).otherwise(F.col("from_entity_id"))
    return [rank, F.desc("confidence"), F.length(other), F.col("edge_type"), F.col("__at")]


def related(edges: DataFrame, entities: DataFrame, entity_id: str, edge_types: list[str] | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
    """Neighbouring symbols, surest first; ends that don't exist are dropped after the limit."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be 'out', 'in' or 'both'")
    directions = ["out", "in"] if direction == "both" else [direction]
    top = _quota(edges, F.lit(entity_id), edge_types, directions, max(1, min(limit, 100)))
    other = F.when(F.col("direction") == "out", F.col("to_entity_id")).otherwise(F.col("from_entity_id"))
    target = entities.select(F.col("entity_id").alias("target_id"), F.struct("entity_id", "qualname", "kind", "page_url", "anchor").alias("target"))
    found = top.withColumn("target_id", other).join(target, "target_id").withColumn("relation_label", relation_label(F.col("edge_type"), F.col("direction")))
    return found.orderBy(*_sorted_key()).select("direction", "edge_type", "source_kind", "param_name", "confidence", "snippet", F.col("page_url").alias("source_page_url"), "line_start", "line_end", "relation_label", "target")


def compact_related(edges: DataFrame, entities: DataFrame, entity_id: str, limit: int = 30) -> DataFrame:
    """(direction, relations): neighbours in words, ``from type to``, without those that only a signature gives."""
    limit = max(1, min(limit, 100))
    top = _quota(edges, F.lit(entity_id), None, ["out", "in"], min(limit * 4, 100)).where("source_kind != 'signature'")
    names = entities.select("entity_id", "qualname")
    found = top.join(names.select(F.col("entity_id").alias("from_entity_id"), F.col("qualname").alias("from_name")), "from_entity_id")
    found = found.join(names.select(F.col("entity_id").alias("to_entity_id"), F.col("qualname").alias("to_name")), "to_entity_id")
    # At most 100 rows are left here.
    found = found.withColumn("at", F.row_number().over(Window.orderBy(*_sorted_key()))).where(F.col("at") <= limit)
    said = F.concat_ws(" ", "from_name", "edge_type", "to_name")
    return found.groupBy("direction").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("said")))), lambda x: x.said).alias("relations"))


# --- diagnostics -------------------------------------------------------------------------


def histogram(edges: DataFrame, column: str) -> DataFrame:
    return edges.groupBy(column).agg(F.count("*").alias("n"))


def top_unresolved(candidates: DataFrame, entities: DataFrame, key: str = "cid", limit: int = 20) -> DataFrame:
    """The commonest unresolved targets: by anchor, else by name (which is never null), else by page."""
    target = F.coalesce(F.nullif("target_anchor", F.lit("")), F.col("target_name"), F.col("target_url")).alias("target")
    return unresolved(candidates, entities, key).groupBy(target).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(limit)


def stats(pages: DataFrame, entities: DataFrame, edges: DataFrame, candidates: DataFrame, source_base: str) -> DataFrame:
    """One row of diagnostics of a root, as one plan: aggregates of one row each, side by side."""
    mine = F.col("source_base") == source_base
    own, near = entities.where(mine), edges.where(mine)
    lost = unresolved(candidates.where(mine).withColumn("cid", F.monotonically_increasing_id()), own)

    def number(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    def counted(column: str, name: str) -> DataFrame:
        return histogram(near, column).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(name))

    target = F.coalesce(F.nullif("target_anchor", F.lit("")), F.col("target_name"), F.col("target_url")).alias("target")
    worst = lost.groupBy(target).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "target").limit(20)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "target")))
    parts = [
        number(pages.where(mine), "pages"),
        number(own, "entities"),
        counted("edge_type", "edges_by_type"),
        counted("source_kind", "edges_by_source"),
        number(lost, "unresolved"),
        worst.agg(F.transform(ranked, lambda x: F.struct(x.target.alias("target"), (-x.less).alias("count"))).alias("top_unresolved")),
        number(stale_edges(near, entities), "stale_edges"),
    ]
    # Each part has one row, and so has their join.
    whole = reduce(lambda a, b: a.join(b, "__one"), [p.withColumn("__one", F.lit(1)) for p in parts])
    return whole.select(F.lit(source_base).alias("source_base"), *[p.columns[0] for p in parts])
