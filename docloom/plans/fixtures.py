"""Engine tables derived from the star schema and the text tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docloom.sources import tables

#: Documents as pages of one root for each source.
PAGES = """
SELECT 'https://docs.example/' || source || '/' || doc_id || '.html' AS url, text AS body, 'https://docs.example/' || source || '/' AS source_base,
       doc_id AS fetched_at FROM documents
"""

#: Regions are classes, nations their methods, suppliers classes that inherit from a nation's name.
ENTITIES = """
SELECT 'r' || r_regionkey AS entity_id, 'tpch' AS source_base, 'p' || r_regionkey AS page_url, r_name AS anchor, 'class' AS kind, r_name AS name,
       r_name AS qualname, 'class ' || r_name || '(object)' AS signature, 'Region ' || r_name AS summary, '' AS body_text,
       CAST(NULL AS VARCHAR(10)) AS parent_entity_id, r_regionkey + 1 AS line_start, r_regionkey + 3 AS line_end FROM region
UNION ALL
SELECT 'n' || n_nationkey, 'tpch', 'p' || n_regionkey, r_name || '.' || n_name, 'method', n_name, r_name || '.' || n_name,
       n_name || '(x: int) -> Optional[' || r_name || ']', 'Nation ' || n_name, '', 'r' || n_regionkey, n_nationkey + 10, n_nationkey + 12
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 's' || s_suppkey, 'tpch', 'p' || n_regionkey, NULL, 'class', s_name, 'supply.' || s_name,
       'class S' || s_suppkey || '(' || n_name || ', list)', '', '', NULL, s_suppkey + 100, s_suppkey + 100
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

#: Customers as parameters of their nation's method.
PARAMS = """
SELECT 'n' || c_nationkey AS entity_id, CAST(c_custkey AS INT) AS ord, c_name AS name,
       CASE c_custkey % 4 WHEN 0 THEN r_name WHEN 1 THEN 'List[' || n_name || ', ' || r_name || ']' WHEN 2 THEN 'int' ELSE 'typing.Optional[Nowhere]' END AS type,
       '' AS default_value, c_mktsegment AS description
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

#: Customers as links of their nation's page, of all the kinds that resolution tells apart.
CANDIDATES = """
SELECT c_custkey AS cid, 'tpch' AS source_base, 'p' || n_regionkey AS page_url, 'n' || c_nationkey AS from_entity_id,
       CASE c_custkey % 2 WHEN 0 THEN 'references' ELSE 'see_also' END AS edge_type,
       CASE c_custkey % 6 WHEN 5 THEN 'text_inference' ELSE 'xref' END AS source_kind,
       CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey % 5) ELSE '' END AS target_url,
       CASE WHEN c_custkey % 5 < 2 THEN r_name WHEN c_custkey % 5 = 2 THEN 'gone' ELSE '' END AS target_anchor,
       CASE WHEN c_custkey % 7 < 3 THEN n_name WHEN c_custkey % 7 = 3 THEN r_name || '.' || n_name WHEN c_custkey % 7 = 4 THEN 'lost' ELSE '' END AS target_name,
       c_mktsegment AS snippet, CAST(0.5 + (c_custkey % 5) / 10.0 AS DOUBLE) AS confidence, CAST(NULL AS INT) AS line_start, CAST(NULL AS INT) AS line_end
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

#: Orders as edges between nations and suppliers; some ends don't exist.
EDGES = """
SELECT 'tpch' AS source_base, 'n' || (o_custkey % 30) AS from_entity_id, 'r' || (o_orderkey % 6) AS to_entity_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'returns' WHEN 1 THEN 'references' WHEN 2 THEN 'has_method' ELSE 'requires' END AS edge_type,
       CASE o_orderkey % 4 WHEN 0 THEN 'signature' WHEN 1 THEN 'xref' WHEN 2 THEN 'structure' ELSE 'text_inference' END AS source_kind,
       '' AS param_name, CAST(0.5 + (o_custkey % 5) / 10.0 AS DOUBLE) AS confidence, o_orderpriority AS snippet,
       'p' || (o_orderkey % 3) AS page_url, CAST(o_orderkey % 7 AS INT) AS line_start, CAST(NULL AS INT) AS line_end, o_orderkey AS edge_no
FROM orders
"""

#: Pages that link to two others each, as a breadth-first search meets them.
LINKS = """
SELECT doc_id AS page, (2 * doc_id + 1) % n AS target, 0 AS pos FROM documents, (SELECT count(*) AS n FROM documents) AS c
UNION ALL
SELECT doc_id, (2 * doc_id + 2) % n, 1 FROM documents, (SELECT count(*) AS n FROM documents) AS c
"""

TABLES = "region nation customer supplier orders documents pages conversations events".split()
_NAMED = re.compile(rf"(?<=FROM |JOIN )({'|'.join(TABLES)})\b")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the Parquet tables it names, which are passed as parameters."""
    found = {t: tables.read(spark, sf_dir, t) for t in set(_NAMED.findall(sql))}
    return spark.sql(_NAMED.sub(r"{\1}", sql), **found)
