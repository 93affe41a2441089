"""Queries of chunks, whole searches, query plans and text functions, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import validate
from docloom.functions.session import workers
from docloom.operators import catalog, chunks, graph, search
from docloom.operators import query as q
from docloom.plans import fixtures as fx
from docloom.plans.book import query
from docloom.sources import tables

_BREAK = "chr(10) || chr(10)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.frame(spark, sf_dir, fx.PAGES).withColumn("title", F.substring_index(F.col("body"), "\n", 1))


# --- chunks ------------------------------------------------------------------------------------

#: Chunks of the pages: runs of lines (C1), one block by lines (C2), greedy packing (C3), hard split with its lines (C4).
_CHUNKS = f"""
p AS (SELECT *, split_part(body, chr(10), 1) AS title, string_split(regexp_replace(body, '\\n$', ''), chr(10)) AS r FROM ({fx.PAGES})),
li AS (SELECT url, unnest(r) AS line, unnest(range(1, len(r) + 1)) AS i FROM p),
fu AS (SELECT url, i, line, i - row_number() OVER (PARTITION BY url ORDER BY i) AS island FROM li WHERE trim(line) <> ''),
pa AS (SELECT url, min(i) AS a, max(i) AS b, trim(string_agg(line, chr(10) ORDER BY i)) AS t FROM fu GROUP BY url, island),
one AS (SELECT pa.url FROM pa JOIN p ON p.url = pa.url GROUP BY pa.url, p.body HAVING count(*) = 1 AND length(any_value(t)) - length(replace(any_value(t), chr(10), '')) > 8 AND NOT contains(trim(p.body), {_BREAK})),
ln AS (SELECT url, i, trim(line) AS t, row_number() OVER (PARTITION BY url ORDER BY i) AS k FROM fu WHERE url IN (SELECT url FROM one)),
s1 AS (SELECT url, k, 1 AS g, length(t) AS size FROM ln WHERE k = 1
  UNION ALL SELECT ln.url, ln.k, CASE WHEN s1.size + 1 + length(ln.t) > 1980 THEN g + 1 ELSE g END, CASE WHEN s1.size + 1 + length(ln.t) > 1980 THEN length(ln.t) ELSE s1.size + 1 + length(ln.t) END
  FROM s1 JOIN ln ON ln.url = s1.url AND ln.k = s1.k + 1),
bl AS (SELECT ln.url, min(ln.i) AS a, max(ln.i) AS b, string_agg(ln.t, ' ' ORDER BY ln.k) AS t FROM s1 JOIN ln ON ln.url = s1.url AND ln.k = s1.k GROUP BY ln.url, g),
pt AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY a) AS k FROM (SELECT * FROM bl UNION ALL SELECT * FROM pa WHERE url NOT IN (SELECT url FROM one))),
s2 AS (SELECT url, k, 1 AS g, length(t) AS size FROM pt WHERE k = 1
  UNION ALL SELECT pt.url, pt.k, CASE WHEN s2.size + 2 + length(pt.t) > 2200 AND s2.size >= 380 THEN g + 1 ELSE g END,
  CASE WHEN s2.size + 2 + length(pt.t) > 2200 AND s2.size >= 380 THEN length(pt.t) ELSE s2.size + 2 + length(pt.t) END FROM s2 JOIN pt ON pt.url = s2.url AND pt.k = s2.k + 1),
pk AS (SELECT pt.url, g, min(a) AS a, max(b) AS b, string_agg(t, {_BREAK} ORDER BY pt.k) AS t FROM s2 JOIN pt ON pt.url = s2.url AND pt.k = s2.k GROUP BY pt.url, g
  UNION ALL SELECT url, 1, 1, 1, '' FROM p WHERE url NOT IN (SELECT url FROM pa)),
ct AS (SELECT *, length(t) AS n, unnest(CASE WHEN length(t) <= 2200 THEN [0] ELSE range(0, greatest(1, length(t) - 180), 2020) END) AS ofs FROM pk),
pc AS (SELECT url, g, ofs, n, a, b, t, substr(t, ofs + 1, 2200) AS chunk, length(left(t, ofs)) - length(replace(left(t, ofs), chr(10), '')) AS br FROM ct),
sc AS (SELECT *, least(b, a + round_even((b - a) * (ofs / (n - 1)), 0)) AS x, least(b, a + round_even((b - a) * ((ofs + length(chunk) - 1) / (n - 1)), 0)) AS y FROM pc),
ch AS (SELECT url, (row_number() OVER (PARTITION BY url ORDER BY g, ofs) - 1)::INT AS ord, chunk,
  (CASE WHEN n <= 2200 THEN a WHEN contains(t, chr(10)) THEN a + br ELSE x END)::INT AS line_start,
  (CASE WHEN n <= 2200 THEN b WHEN contains(t, chr(10)) THEN a + br + length(chunk) - length(replace(chunk, chr(10), '')) ELSE greatest(x, y) END)::INT AS line_end FROM sc)"""


@query("chunk_pages", f"WITH RECURSIVE {_CHUNKS} SELECT url, ord, line_start, line_end, md5(chunk) AS digest FROM ch")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(_pages(spark, sf_dir)).select("url", "ord", "line_start", "line_end", F.md5("chunk").alias("digest"))


@query(
    "chunk_paragraphs",
    f"WITH RECURSIVE {_CHUNKS.replace(f'({fx.PAGES})', '(SELECT * REPLACE (replace(body, chr(46) || chr(32), chr(10) || chr(10)) AS body) FROM (' + fx.PAGES + '))')} SELECT url, ord, line_start, line_end, md5(chunk) AS digest FROM ch",
)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of pages of many paragraphs."""
    pages = _pages(spark, sf_dir).withColumn("body", F.replace("body", F.lit(". "), F.lit("\n\n")))
    return chunks.chunk(pages).select("url", "ord", "line_start", "line_end", F.md5("chunk").alias("digest"))


# --- the whole search -----------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(q.STOPWORDS)) + "]"
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_IDF = "CASE WHEN ln((n - n{0} + 0.5) / (n{0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{0} + 0.5) / (n{0} + 0.5)) END * (f{0} * 2.2 / (f{0} + 1.2 * (0.25 + 0.75 * d / mean)))"
#: Hits for all of one word and one of others (here one), each with its best line, and the line's number on the page.
_SEARCH = f"""
tk AS (SELECT ch.*, p.title, p.r, p.source_base, list_concat({_WORDS.format('p.title')}, {_WORDS.format('chunk')}) AS w FROM ch JOIN p ON p.url = ch.url),
fr AS (SELECT *, len(w) AS d, len(list_filter(w, lambda x: x = 'erthat')) AS f0, len(list_filter(w, lambda x: x = 'thing')) AS f1 FROM tk),
su AS (SELECT count(*)::DOUBLE AS n, avg(d) AS mean, sum((f0 > 0)::INT)::DOUBLE AS n0, sum((f1 > 0)::INT)::DOUBLE AS n1 FROM fr),
rk AS (SELECT fr.*, -({_IDF.format(0)} + {_IDF.format(1)}) AS rank FROM fr, su WHERE f0 > 0 AND f1 > 0),
cp AS (SELECT * FROM rk ORDER BY rank, url, ord LIMIT 800),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, ord) AS k FROM cp) WHERE k = 1 ORDER BY rank, url LIMIT 20),
cl AS (SELECT url, unnest(string_split(trim(chunk), chr(10))) AS line, unnest(range(0, len(string_split(trim(chunk), chr(10))))) AS i FROM bs),
bl2 AS (SELECT url, arg_max(trim(line), [contains(lower(line), 'erthat')::INT + contains(lower(line), 'thing')::INT, length(trim(line)), -i]) AS snippet,
  arg_max(i, [contains(lower(line), 'erthat')::INT + contains(lower(line), 'thing')::INT, length(trim(line)), -i]) AS off FROM cl WHERE trim(line) <> '' GROUP BY url),
hs AS (SELECT bs.url, bs.title, left(bl2.snippet, 800) AS snippet, bl2.off, rank, bs.line_start, bs.line_end, bs.chunk, bs.r FROM bs JOIN bl2 ON bl2.url = bs.url),
ow AS (SELECT *, list_distinct(list_filter(list_transform(string_split_regex(lower(snippet), '\\s+'), lambda x: trim(x, '"'',.;:!?()[]')),
  lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x) AND x NOT IN ('erthat', 'thing'))) AS own FROM hs),
bd AS (SELECT url, lower(snippet) AS low, own, unnest(r[line_start:line_end]) AS line, unnest(range(0, len(r[line_start:line_end]))) AS i FROM ow),
sb AS (SELECT url, i, CASE WHEN contains(lower(trim(line)), low) THEN 1000 ELSE 0 END + 100 * (contains(lower(line), 'erthat')::INT + contains(lower(line), 'thing')::INT + len(list_filter(own, lambda x: contains(lower(line), x)))) AS score,
  length(trim(line)) AS size FROM bd WHERE trim(line) <> ''),
lb AS (SELECT url, arg_max(i, [score, size, -i]) AS i, max(score) AS score FROM sb GROUP BY url)"""


@query(
    "search_pages",
    f"""WITH RECURSIVE {_CHUNKS}, {_SEARCH}
SELECT hs.url, hs.title, hs.snippet, round(rank, 6) AS rank, (line_start + CASE WHEN contains(trim(chunk), chr(10)) THEN off WHEN lb.score > 0 THEN lb.i ELSE 0 END)::INT AS line,
line_start AS chunk_line_start, line_end AS chunk_line_end FROM hs LEFT JOIN lb ON lb.url = hs.url""",
)
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: chunks, stages, cap, one hit for each page, its best line and that line's number."""
    pages = _pages(spark, sf_dir)
    found = search.search(None, chunks.chunk(pages), pages, "erthat thing", 20)
    return found.select("url", "title", "snippet", F.round("rank", 6).alias("rank"), "line", "chunk_line_start", "chunk_line_end")


# --- query plans ---------------------------------------------------------------------------------------

_ASKED = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN array_to_string(w[1:7], ' ') WHEN 1 THEN '"' || coalesce(w[1], '') || ' ' || coalesce(w[2], '') || '" ' || array_to_string(w[3:8], ' ')
 WHEN 2 THEN array_to_string(w[1:3], ' ') ELSE 'Send_Photo guide v2.1 ' || array_to_string(w[1:3], ' ') || ' the API Send_photo' END AS asked
FROM (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS w FROM documents WHERE text IS NOT NULL)"""
_LOW = "[" + ", ".join(f"'{w}'" for w in sorted(q.LOW_SIGNAL)) + "]"
_QUOTED = "list_transform({0}, lambda x: chr(34) || replace(x, chr(34), chr(34) || chr(34)) || chr(34))"
_MATCH = (
    "CASE WHEN len({0}) + len({1}) = 0 THEN NULL WHEN len({1}) = 0 THEN array_to_string(" + _QUOTED.format("{0}") + ", ' AND ') WHEN len({0}) > 0 THEN array_to_string(" + _QUOTED.format("{0}")
    + ", ' AND ') || ' AND (' || array_to_string(" + _QUOTED.format("{1}") + ", ' OR ') || ')' WHEN len({1}) = 1 THEN '(' || (" + _QUOTED.format("{1}") + ")[1] || ')' ELSE array_to_string(" + _QUOTED.format("{1}") + ", ' OR ') END"
)


@query(
    "query_plans",
    f"""WITH a AS ({_ASKED}),
b AS (SELECT doc_id, asked, list_filter(list_transform(regexp_extract_all(asked, '"([^"]*)"', 1), lambda x: trim(x)), lambda x: x <> '') AS ph,
  list_filter(list_transform(string_split_regex(regexp_replace(asked, '"[^"]*"', ' ', 'g'), '\\s+'), lambda x: trim(x, '"'',.;:!?()[]')), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, lower(x))) AS ws FROM a),
c AS (SELECT *, list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i) AS tk FROM b),
t AS (SELECT doc_id, unnest(tk) AS t, unnest(range(1, len(tk) + 1)) AS i, len(ph) + len(tk) >= 5 AS free FROM c),
u AS (SELECT *, list_contains({_LOW}, lower(t)) AS low, regexp_matches(t, '[_.]') AS dot, length(t) > 3 AND NOT (t = lower(t) AND t <> upper(t)) AS mixed, regexp_matches(t, '\\p{{Nd}}') AS digit FROM t),
v AS (SELECT *, length(t) > 5 OR dot OR digit OR mixed AS strong FROM u),
w AS (SELECT *, CASE WHEN max(strong::INT) OVER (PARTITION BY doc_id) = 1 THEN strong ELSE true END AS pool FROM v),
x AS (SELECT *, pool AND CASE WHEN max((pool AND NOT low)::INT) OVER (PARTITION BY doc_id) = 1 THEN NOT low ELSE true END AS pick FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY low, dot DESC, mixed DESC, digit DESC, length(t) DESC, i) AS place,
  row_number() OVER (PARTITION BY doc_id, pick ORDER BY low, dot DESC, mixed DESC, digit DESC, length(t) DESC, i) AS turn FROM x),
z AS (SELECT doc_id, any_value(free) AS free, coalesce(list(t ORDER BY i) FILTER (pick AND turn <= CASE WHEN free THEN 2 ELSE 3 END), []) AS need, list(t ORDER BY place)[1:12] AS loose FROM y GROUP BY doc_id),
d AS (SELECT c.doc_id, c.ph, c.tk, coalesce(z.free, len(c.ph) >= 5) AS free, coalesce(z.need, []) AS need, coalesce(z.loose, []) AS loose FROM c LEFT JOIN z ON z.doc_id = c.doc_id),
e AS (SELECT *, list_concat(ph, need) AS e1, list_filter(tk, lambda x: NOT list_contains(need, x))[1:20] AS o1, list_filter(tk, lambda x: x <> need[1])[1:20] AS o2 FROM d),
m AS (SELECT doc_id, {_MATCH.format('e1', 'o1')} AS m1, CASE WHEN len(need) > 0 AND len(o1) > 0 THEN {_MATCH.format('list_concat(ph, need[1:1])', 'o2')} END AS m2,
  CASE WHEN len(ph) > 0 THEN {_MATCH.format('ph', 'loose')} WHEN free THEN {_MATCH.format('[]::VARCHAR[]', 'loose')} END AS m3 FROM e)
SELECT doc_id, array_to_string(list_filter([m1, CASE WHEN m2 IS DISTINCT FROM m1 THEN m2 END, CASE WHEN m3 IS DISTINCT FROM m1 AND m3 IS DISTINCT FROM m2 THEN m3 END], lambda x: x IS NOT NULL), ' || ') AS plan FROM m""",
)
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match stages of a query for each document: pieces, strong and telling tokens, required ones, fallback."""
    w = F.split(F.regexp_replace("text", "^\\s+|\\s+$", ""), "\\s+")
    part = lambda n, at=1: F.array_join(F.slice(w, at, n), " ")
    asked = (
        F.when(F.col("doc_id") % 4 == 0, part(7))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('"'), F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.lit(" "), F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.lit('" '), part(6, 3)))
        .when(F.col("doc_id") % 4 == 2, part(3))
        .otherwise(F.concat(F.lit("Send_Photo guide v2.1 "), part(3), F.lit(" the API Send_photo")))
    )
    asks = tables.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", asked.alias("asked"))
    return q.plans(asks, "asked").select("doc_id", F.array_join("plan", " || ").alias("plan"))


# --- text functions ------------------------------------------------------------------------------------------

_MESSY = "'  ' || p_name || '\u00b6 ( ' || p_type || ' ,x ) : y=z  | w\u2192v ) -q . r . a. b http: //' || p_partkey || ' [ 1 ]  end  \u2013 f (g) !  '"
#: The rewrites of running text, in their order; a dotted name is closed up twice, since a match takes its neighbours with it.
_REWRITES = (
    ("\\s+([,.;!?%)\\]}])", "\\1"), ("([(\\[{])\\s+", "\\1"), ("\\s*,\\s*", ", "), ("\\s*:\\s*", ": "), ("\\s*([=|\u2192])\\s*", " \\1 "), ("\\)\\s*[\u2013-]\\s*", ") \u2013 "),
    ("\\s+[\u2013-]\\s+", " \u2013 "), (":\\s+//", "://"), ("([A-Za-z0-9_])\\.\\s+([A-Za-z0-9_])", "\\1.\\2"), ("([A-Za-z0-9_])\\.\\s+([A-Za-z0-9_])", "\\1.\\2"),
)


def _rewritten(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in rules:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


_FLAT = f"trim(regexp_replace(replace({_MESSY}, '\u00b6', ' '), '\\s+', ' ', 'g'))"


@query(
    "inline_text",
    f"SELECT p_partkey, trim(regexp_replace({_MESSY}, '\\s+', ' ', 'g')) AS collapsed, {_rewritten(_FLAT, _REWRITES)} AS inline, {_rewritten(_FLAT, (*_REWRITES, ('\\s+([(\\[{])', '\\1')))} AS compact FROM part",
)
def inline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space, running text and compact signatures, normalised."""
    messy = F.expr(_MESSY)
    return tables.read(spark, sf_dir, "part").select("p_partkey", tx.collapse(messy).alias("collapsed"), tx.inline(messy).alias("inline"), tx.inline(messy, compact=True).alias("compact"))


@query(
    "signature_names",
    f"WITH e AS ({fx.ENTITIES}) SELECT entity_id, name || '_x' AS name, qualname || '_x' AS qualname FROM e",
)
def signature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read from signatures, with and without a leading keyword."""
    word = F.element_at(F.array(*map(F.lit, ("", "class ", "async ", "staticmethod ", "abstract "))), (F.col("line_start") % 5 + 1).cast("int"))
    signature = F.concat(word, F.col("qualname"), F.lit("_x (a: int = f(1)) -> "), F.col("name"))
    found = tx.signature_qualname(signature)
    return fx.frame(spark, sf_dir, fx.ENTITIES).select("entity_id", F.concat(F.element_at(F.split(F.substring_index(found, "_x", 1), "\\."), -1), F.lit("_x")).alias("name"), found.alias("qualname"))


@query(
    "parameter_items",
    """SELECT p_partkey, 'p' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN '' WHEN 2 THEN p_type ELSE '' END AS type,
CASE p_partkey % 4 WHEN 0 THEN p_name || ' - more' WHEN 1 THEN p_name ELSE '' END AS description FROM part""",
)
def parameter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items ``name(type) - description`` taken apart."""
    k, name = F.col("p_partkey") % 4, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    item = (
        F.when(k == 0, F.concat(name, F.lit("(int) \u2013 "), F.col("p_name"), F.lit(" - more")))
        .when(k == 1, F.concat(name, F.lit(" - "), F.col("p_name")))
        .when(k == 2, F.concat(F.lit("  "), name, F.lit("("), F.col("p_type"), F.lit(") ")))
        .otherwise(name)
    )
    return tables.read(spark, sf_dir, "part").select("p_partkey", tx.parameter_item(item).alias("i")).select("p_partkey", "i.*")


@query(
    "version_notes",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'versionadded' WHEN 1 THEN 'versionchanged' WHEN 2 THEN 'versionremoved' WHEN 3 THEN 'deprecated' END AS kind,
CASE WHEN p_partkey % 5 < 4 THEN '1.' || p_partkey END AS version, CASE WHEN p_partkey % 5 = 2 THEN 'Removed in version 1.' || p_partkey || ':' WHEN p_partkey % 5 < 4 THEN p_name END AS text FROM part""",
)
def version_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version sentences taken apart; one without a text stays whole."""
    k = F.col("p_partkey") % 5
    head = F.element_at(F.array(*map(F.lit, ("Added in version", "Changed in version", "Removed in version", "Deprecated since version", "Known since version"))), (k + 1).cast("int"))
    said = F.concat(head, F.lit(" 1."), F.col("p_partkey").cast("string"), F.lit(":"), F.when(k == 2, "").otherwise(F.concat(F.lit(" "), F.col("p_name"))))
    return tables.read(spark, sf_dir, "part").select("p_partkey", tx.version_note(said).alias("n")).select("p_partkey", "n.kind", "n.version", "n.text")


@query("json_lists", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_type ELSE '' END AS texts FROM part")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of texts; anything else is the empty one."""
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.to_json(F.array("p_name", "p_type"))).when(k == 1, F.lit("{broken"))
    return tables.read(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.json_list(raw), "|").alias("texts"))


# --- prose, status ----------------------------------------------------------------------------------------------

_TURN = "CAST(conv_id AS VARCHAR) || '#' || CAST(CAST(turn AS INT) AS VARCHAR)"


@query(
    "text_inference",
    f"""WITH t AS (SELECT {_TURN} AS id, role, regexp_replace(text, '[.\\n]', ';', 'g') AS s FROM conversations),
u AS (SELECT DISTINCT id, role, trim(s) AS s FROM t)
SELECT id AS from_entity_id, 'requires' AS edge_type, role || '_x' AS target_name, left('Mind ' || s || ' must be used with ' || role || '_x and is similar to Turn.', 300) AS snippet, 0.7::DOUBLE AS confidence FROM u
UNION ALL SELECT id, 'similar_to', 'Turn', left('Mind ' || s || ' must be used with ' || role || '_x and is similar to Turn.', 300), 0.65 FROM u
UNION ALL SELECT id, 'converts_to', 'UserTurn', 'See from_user_turn.', 0.6 FROM u""",
)
def text_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations stated in turns of conversations, each with its sentence."""
    turns = fx.frame(spark, sf_dir, f"SELECT {_TURN.replace('VARCHAR', 'STRING')} AS entity_id, role, text FROM conversations")
    said = F.concat(F.lit("First. Mind "), F.trim(F.regexp_replace("text", "[.\\n]", ";")), F.lit(" must be used with "), F.col("role"), F.lit("_x and is similar to Turn. See from_user_turn."))
    entities = turns.select("entity_id", F.lit("talk").alias("source_base"), F.lit("p").alias("page_url"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), said.alias("body_text"))
    found = graph.text_candidates(entities, spark.createDataFrame([], "entity_id string, ord int, text string"))
    return found.select("from_entity_id", "edge_type", "target_name", "snippet", "confidence")


@query(
    "status_text",
    f"""WITH s AS (SELECT source_base, count(*) AS page_count, max(fetched_at) AS last FROM ({fx.PAGES}) GROUP BY source_base)
SELECT '{{"sources":[' || string_agg('{{"source_base":"' || source_base || '","page_count":' || page_count || ',"last_fetched_at":' || last || '}}', ',' ORDER BY source_base) || '],"total_pages":' || CAST(sum(page_count) AS BIGINT) || '}}' AS json FROM s""",
)
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of roots as JSON."""
    return catalog.status(_pages(spark, sf_dir))


# --- parameters ----------------------------------------------------------------------------------------------------


@query(
    "checked_parameters",
    """SELECT p_partkey, p_partkey BETWEEN 1 AND 100 AS limit_ok, p_partkey BETWEEN 1 AND 500 AS pages_ok, p_partkey <= 30 AS delay_ok, p_partkey % 3 <> 1 AS kind_ok,
p_partkey % 4 <> 0 AS symbol_ok, p_partkey % 5 < 3 AS url_ok, p_partkey >= 1 AND p_partkey <= 1000 AS slice_ok, p_partkey % 2 = 0 AS edge_ok FROM part""",
)
def checked_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parameters the checks let through, for a row of values from each part."""

    def ok(check, *values) -> bool:
        try:
            check(*values)
        except ValueError:
            return False
        return True

    def rows(batches):
        for batch in batches:
            out = []
            for k in batch["p_partkey"]:
                url = ("https://a.example/x", " http://b.example ", "https://c", "ftp://d.example", "no address")[k % 5]
                found = [ok(validate.number, "limit", k), ok(validate.number, "pages_limit", k), ok(validate.number, "delay", k), ok(validate.kind, ("class", "module", None)[k % 3])]
                found += [ok(validate.symbol, "" if k % 4 == 0 else f" S{k} "), ok(validate.web_url, "u", url), ok(validate.line_slice, k, k * 6 - 1 + (0 if k <= 1000 else 1)), ok(validate.edge_types, [("returns", "other")[k % 2]])]
                out.append((k, *found))
            yield pd.DataFrame(out, columns=["p_partkey", *_CHECKS])

    workers(spark)
    return tables.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long")).mapInPandas(rows, "p_partkey long, " + ", ".join(f"{c} boolean" for c in _CHECKS))


_CHECKS = [f"{c}_ok" for c in ("limit", "pages", "delay", "kind", "symbol", "url", "slice", "edge")]
