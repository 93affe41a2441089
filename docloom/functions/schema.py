"""Schemas of the engine's tables, and the keys that make their rows unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "url string, title string, body string, source_base string, fetched_at long, toc variant"
CHUNKS = "url string, ord int, line_start int, line_end int, title string, chunk string"
ENTITIES = (
    "entity_id string, source_base string, page_url string, anchor string, kind string, name string, qualname string, signature string, "
    "summary string, body_text string, parent_entity_id string, line_start int, line_end int"
)
PARAMS = "entity_id string, ord int, name string, type string, default_value string, description string"
NOTES = "entity_id string, ord int, kind string, version string, text string"
EDGES = (
    "source_base string, from_entity_id string, to_entity_id string, edge_type string, source_kind string, param_name string, confidence double, "
    "snippet string, page_url string, line_start int, line_end int"
)
CANDIDATES = (
    "source_base string, page_url string, from_entity_id string, edge_type string, source_kind string, target_url string, target_anchor string, "
    "target_name string, snippet string, confidence double, line_start int, line_end int"
)
#: Full-text indexes of chunks and entities, laid out by term.
CHUNK_POSTINGS = "term string, url string, ord int, length long, positions array<int>"
CHUNK_LENGTHS = "url string, ord int, length long"
ENTITY_POSTINGS = "term string, entity_id string, length long, positions array<int>"
ENTITY_LENGTHS = "entity_id string, length long"
INDEX_TOTALS = "n long, mean double"
INDEXES = {"chunk_totals": INDEX_TOTALS, "entity_totals": INDEX_TOTALS, "chunk_postings": CHUNK_POSTINGS, "chunk_lengths": CHUNK_LENGTHS, "entity_postings": ENTITY_POSTINGS, "entity_lengths": ENTITY_LENGTHS}
TABLES = {"pages": PAGES, "chunks": CHUNKS, "entities": ENTITIES, "params": PARAMS, "notes": NOTES, "edges": EDGES, "candidates": CANDIDATES, **INDEXES}

#: Columns whose equality makes two rows one; null line numbers are equal.
EDGE_KEY = ["from_entity_id", "to_entity_id", "edge_type", "source_kind", "param_name", "page_url", "line_start", "line_end"]
CANDIDATE_KEY = ["from_entity_id", "edge_type", "source_kind", "target_url", "target_anchor", "target_name", "snippet", "line_start", "line_end"]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, table: str, also: list[str] = []) -> DataFrame:
    """The table's columns in order, then those of ``also``; missing ones are added with their default (empty text, confidence 1)."""
    from pyspark.sql.types import StructType

    nullable = {"anchor", "parent_entity_id", "line_start", "line_end", "toc"}
    out: list[Column] = []
    for f in StructType.fromDDL(TABLES[table]).fields:
        blank = F.lit(None) if f.name in nullable else F.lit(1.0) if f.name == "confidence" else F.lit("") if f.dataType.typeName() == "string" else F.lit(None)
        value = F.col(f"`{f.name}`") if f.name in df.columns else blank
        out.append(value.cast(f.dataType).alias(f.name) if f.name != "toc" or f.name not in df.columns else value)
    return df.select(*out, *also)
