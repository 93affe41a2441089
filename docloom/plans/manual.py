"""Queries over the pages of a manual that is written from the table of suppliers.

Each supplier has a page with sections, a documented class and its method.  The
engine reads the pages' markup; the SQL states from the suppliers what must
come out, so it shares nothing with the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import catalog, graph
from docloom.operators.store import cut
from docloom.plans.book import query
from docloom.sources import html, tables

BASE = "https://docs.example/manual/"
_PAGE = """<html><head><title>Manual of S{k}</title><script>drop({k})</script><style>p {{}}</style></head><body><nav><a href="skip.html">skip</a></nav><article>not this</article>
<div class="rst-content"><section id="top"><h1>S{k}<a class="headerlink" href="#top">\u00b6</a></h1><p>Lead of <em>S{k}</em> , in m{m} .</p>
<section id="use"><h2>Use</h2><p>Use lead.</p><pre>code {k}
  kept</pre><ul><li>first {k}</li><li><p>second</p><ul><li>deep</li></ul></li></ul></section><section><h2>No id</h2></section></section>
<dl class="py class"><dt class="sig" id="m{m}.S{k}"><em class="property">class</em> <span class="sig-name descname">S{k}</span>(<em class="sig-param">key: int</em>, <em class="sig-param">*rest</em>, <em class="sig-param">size={z}</em>)</dt>
<dd><p>Supplier {k}. See <a href="s{n}.html#m{o}.S{n}">S{n}</a>.</p>
<dl class="field-list"><dt>Parameters</dt><dd><ul><li>key (int) \u2013 the key</li><li>more (str) - extra {z}</li></ul></dd><dt>Returns:</dt><dd><p>A thing</p></dd></dl>
<div class="warning"><p>Careful <a href="#care{k}">here</a></p><div class="note"><p>nested</p></div></div>
<div class="versionadded"><p>Added in version 2.{z}: the supplier</p></div>
<p>Changed in version 3.{m}: faster</p><p>Deprecated since version 4: use <a href="x.html">nothing</a></p>
<div class="seealso"><p><a href="index.html?highlight=q#top">Top</a></p></div>
<dl class="py method"><dt id="m{m}.S{k}.run">async <span class="descname">run</span>(<em class="sig-param">photo: File = None</em>) \u2192 S{n}</dt><dd><p>Runs. must be used with S{n}. <a href="#m{m}.S{k}">S{k}</a></p></dd></dl>
</dd></dl></div></body></html>"""
_FIELDS = {"k": "s_suppkey", "m": "s_suppkey % 7", "n": "s_suppkey + 1", "o": "(s_suppkey + 1) % 7", "z": "s_suppkey % 5"}
#: The suppliers with the values of _FIELDS, in DuckDB.
SUPPLIERS = f"s AS (SELECT {', '.join(f'({v})::VARCHAR AS {k}' for k, v in _FIELDS.items())}, s_suppkey FROM supplier), p AS (SELECT *, '{BASE}s' || k || '.html' AS url FROM s)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html) of the manual. A supplier of some 20 bytes becomes a page of 2 KB."""
    values = [F.expr(v).cast("string") for v in _FIELDS.values()]
    text, order = _PAGE.replace("{{", "\x01").replace("}}", "\x02"), list(_FIELDS)
    parts: list = []
    while "{" in text:
        head, _, text = text.partition("{")
        name, _, text = text.partition("}")
        parts += [F.lit(head), values[order.index(name)]]
    page = F.concat(*parts, F.lit(text))
    page = F.translate(page, "\x01\x02", "{}")
    return tables.read(spark, sf_dir, "supplier", weight=100).select(F.concat(F.lit(BASE + "s"), F.col("s_suppkey").cast("string"), F.lit(".html")).alias("url"), page.alias("html"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manual's entities; each page is read once, whatever refers to them."""
    return cut(html.entity_rows(cut(html.parse(pages(spark, sf_dir))), BASE))


_SIGNATURE = "'class S' || k || '(key: int, *rest, size = ' || z || ')'"
_RUN = "'async run(photo: File = None) → S' || n"
_FIELD_TEXT = "'Parameters:' || chr(10) || 'key(int) – the key' || chr(10) || 'more(str) – extra ' || z || chr(10) || 'Returns:' || chr(10) || 'A thing'"
#: On the page a paragraph is one block; in an object's text its strings and links are blocks of their own.
_NOTE_BLOCKS = "'Added in version 2.' || z || ': the supplier'"
_CLASS_BLOCKS = f"""['Supplier ' || k || '.See S' || n || '.', {_FIELD_TEXT}, 'Careful here', 'nested', {_NOTE_BLOCKS}, 'Changed in version 3.' || m || ': faster', 'Deprecated since version 4: use nothing', 'Top']"""
_CLASS_TEXT = f"""['Supplier ' || k || '.See', 'S' || n, '.', {_FIELD_TEXT}, 'Careful here', 'nested', {_NOTE_BLOCKS}, 'Changed in version 3.' || m || ': faster', 'Deprecated since version 4: use', 'nothing', 'Top']"""
_TOP_BLOCKS = "['S' || k, 'Lead of S' || k || ', in m' || m || '.', 'Use', 'Use lead.', 'code ' || k || chr(10) || '  kept', 'first ' || k, 'second', 'deep', 'No id']"
_RUN_LINE = "'Runs.must be used with S' || n || '.S' || k"
_RUN_TEXT = "'Runs.must be used with S' || n || '.' || chr(10) || chr(10) || 'S' || k"
BODY = f"array_to_string(list_concat({_TOP_BLOCKS}, [{_SIGNATURE}], {_CLASS_BLOCKS}, [{_RUN}, {_RUN_LINE}]), chr(10) || chr(10))"


@query("manual_text", f"WITH {SUPPLIERS} SELECT url, 'Manual of S' || k AS title, {BODY} AS body FROM p")
def manual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text of each page: main content, headings, paragraphs, code, lists, objects, field lists."""
    return html.parse(pages(spark, sf_dir)).select("url", "title", "body")


@query(
    "manual_contents",
    f"""WITH {SUPPLIERS} SELECT url, '0' AS path, 1::INT AS level, 'top' AS id, 'S' || k AS title, 'Lead of S' || k || ', in m' || m || '.' AS summary FROM p
UNION ALL SELECT url, '0.0', 2, 'use', 'Use', 'Use lead.' FROM p""",
)
def manual_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents, as rows."""
    return html.toc_rows(html.parse(pages(spark, sf_dir)))


@query(
    "manual_contents_json",
    f"""WITH {SUPPLIERS} SELECT url, '[{{"id": "top", "title": "S' || k || '", "summary": "Lead of S' || k || ', in m' || m || '.", "level": 1, "url": "' || url || '#top", "children": [{{"id": "use", "title": "Use", "summary": "Use lead.", "level": 2, "url": "'
|| url || '#use", "children": []}}]}}]' AS toc FROM p""",
)
def manual_contents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents, as JSON."""
    return html.parse(pages(spark, sf_dir)).select("url", F.col("toc_json").alias("toc"))


#: The line of an object is the first that holds its signature or its name; for a class that is the page's heading.
OBJECTS = f"""o AS (SELECT url, k, m, n, o, z, url || '#m' || m || '.S' || k AS entity_id, NULL AS parent_entity_id, 'class' AS kind, 'S' || k AS name, 'm' || m || '.S' || k AS qualname, {_SIGNATURE} AS signature,
 'Supplier ' || k || '.See S' || n || '.' AS summary, array_to_string({_CLASS_TEXT}, chr(10) || chr(10)) AS body_text, 1::INT AS line_start FROM p
UNION ALL SELECT url, k, m, n, o, z, url || '#m' || m || '.S' || k || '.run', url || '#m' || m || '.S' || k, 'method', 'run', 'm' || m || '.S' || k || '.run', {_RUN}, {_RUN_LINE}, {_RUN_TEXT},
 (1 + len(string_split(string_split({BODY}, {_RUN})[1], chr(10))) - 1)::INT FROM p)"""


@query(
    "manual_entities",
    f"""WITH {SUPPLIERS}, {OBJECTS} SELECT entity_id, parent_entity_id, kind, name, qualname, signature, summary, line_start FROM o""",
)
def manual_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented objects: kind, names, signature, owner, summary and line."""
    return _entities(spark, sf_dir).select("entity_id", "parent_entity_id", "kind", "name", "qualname", "signature", "summary", "line_start")


@query("manual_entity_texts", f"WITH {SUPPLIERS}, {OBJECTS} SELECT entity_id, body_text FROM o")
def manual_entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of objects without those of the objects inside them."""
    return _entities(spark, sf_dir).select("entity_id", "body_text")


@query(
    "manual_params",
    f"""WITH {SUPPLIERS}, {OBJECTS}, c AS (SELECT * FROM o WHERE kind = 'class')
SELECT entity_id, 0::INT AS ord, 'key' AS name, 'int' AS type, '' AS default_value, 'the key' AS description FROM c
UNION ALL SELECT entity_id, 1, 'rest', '', '', '' FROM c UNION ALL SELECT entity_id, 2, 'size', '', z, '' FROM c UNION ALL SELECT entity_id, 3, 'more', 'str', '', 'extra ' || z FROM c
UNION ALL SELECT entity_id, 0, 'photo', 'File', 'None', '' FROM o WHERE kind = 'method'""",
)
def manual_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of signatures and field lists, merged by name."""
    return html.child_tables(_entities(spark, sf_dir))[0]


_NOTES = f"""c AS (SELECT * FROM o WHERE kind = 'class'), t AS (SELECT entity_id, 'warning' AS kind, '' AS version, 'Careful here nested' AS text FROM c
UNION ALL SELECT entity_id, 'versionadded', '2.' || z, 'the supplier' FROM c UNION ALL SELECT entity_id, 'versionchanged', '3.' || m, 'faster' FROM c
UNION ALL SELECT entity_id, 'deprecated', '4', 'use nothing' FROM c)"""


@query("manual_notes", f"WITH {SUPPLIERS}, {OBJECTS}, {_NOTES} SELECT entity_id, kind, version, text FROM t")
def manual_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of objects, of classes and of sentences; a note in a note is part of it."""
    return html.child_tables(_entities(spark, sf_dir))[1].select("entity_id", "kind", "version", "text")


@query(
    "manual_searched_texts",
    f"""WITH {SUPPLIERS}, {OBJECTS} SELECT entity_id, body_text || CASE WHEN kind = 'class' THEN chr(10) || chr(10) || 'warning Careful here nested' || chr(10) || 'versionadded Added in version 2.' || z || ' the supplier' || chr(10)
|| 'versionchanged Changed in version 3.' || m || ' faster' || chr(10) || 'deprecated Deprecated since version 4 use nothing' ELSE '' END AS body FROM o""",
)
def manual_searched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the entity index searches: an object's text, then its notes with their labels."""
    entities = _entities(spark, sf_dir)
    return catalog.entity_rows(entities, html.child_tables(entities)[1]).select("entity_id", "body")


_LINKS = f"""x AS (SELECT entity_id, 'references' AS edge_type, '{BASE}s' || n || '.html' AS target_url, 'm' || o || '.S' || n AS target_anchor, 'S' || n AS target_name FROM o WHERE kind = 'class'
UNION ALL SELECT entity_id, 'mentioned_in_warning', url, 'care' || k, 'here' FROM o WHERE kind = 'class' UNION ALL SELECT entity_id, 'see_also', '{BASE}', 'top', 'Top' FROM o WHERE kind = 'class'
UNION ALL SELECT entity_id, 'references', url, 'm' || m || '.S' || k, 'S' || k FROM o WHERE kind = 'method')"""


@query("manual_links", f"WITH {SUPPLIERS}, {OBJECTS}, {_LINKS} SELECT entity_id AS from_entity_id, edge_type, target_url, target_anchor, target_name, 'xref' AS source_kind, 1.0::DOUBLE AS confidence FROM x")
def manual_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of objects as candidates, with the relation that the place of a link gives and the defaults of what it lacks."""
    return graph.link_candidates(_entities(spark, sf_dir)).select("from_entity_id", "edge_type", "target_url", "target_anchor", "target_name", "source_kind", "confidence")


EDGES = f"""{_LINKS}, i AS (SELECT 'S' || k AS name, url || '#m' || m || '.S' || k AS id FROM p),
g AS (SELECT DISTINCT x.entity_id AS from_entity_id, i.id AS to_entity_id, x.edge_type, 'xref' AS source_kind FROM x JOIN p ON x.target_url = p.url AND x.target_anchor = 'm' || p.m || '.S' || p.k JOIN i ON i.id = p.url || '#' || x.target_anchor
UNION ALL SELECT parent_entity_id, entity_id, 'has_method', 'structure' FROM o WHERE kind = 'method'
UNION ALL SELECT entity_id, i.id, 'returns', 'signature' FROM o JOIN i ON i.name = 'S' || n WHERE kind = 'method'
UNION ALL SELECT entity_id, i.id, 'requires', 'text_inference' FROM o JOIN i ON i.name = 'S' || n WHERE kind = 'method')"""


@query("manual_graph", f"WITH {SUPPLIERS}, {OBJECTS}, {EDGES} SELECT from_entity_id, to_entity_id, edge_type, source_kind FROM g")
def manual_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph of the manual: structure, signatures, links and prose, resolved over all pages."""
    entities = _entities(spark, sf_dir)
    params, notes = html.child_tables(entities)
    return graph.build(entities, params, notes, graph.link_candidates(entities))[0].select("from_entity_id", "to_entity_id", "edge_type", "source_kind")


@query("manual_link_edges", f"WITH {SUPPLIERS}, {OBJECTS}, {EDGES} SELECT from_entity_id, to_entity_id, edge_type FROM g WHERE source_kind IN ('xref', 'text_inference') AND from_entity_id LIKE '%s1%'")
def manual_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that links and prose give, of the pages named so."""
    entities = _entities(spark, sf_dir)
    _, notes = html.child_tables(entities)
    stated = graph.unique_candidates(graph.link_candidates(entities).unionByName(graph.text_candidates(entities, notes)))
    mine = stated.where(F.col("source_kind").isin("xref", "text_inference") & F.col("page_url").contains("s1"))
    return graph.resolved_edges(mine, entities).select("from_entity_id", "to_entity_id", "edge_type")


@query(
    "manual_symbol",
    f"""WITH {SUPPLIERS}, {OBJECTS}, x AS (SELECT o.*, string_split({BODY}, chr(10)) AS r, o.line_start + length(o.body_text) - length(replace(o.body_text, chr(10), '')) AS line_end FROM o WHERE qualname = 'm4.S4.run')
SELECT true AS found, qualname AS symbol_name, url AS page_url, entity_id AS url_with_anchor, kind, line_start, greatest(1, line_start - 8)::INT AS context_start, least(len(r), line_end + 16)::INT AS context_end,
array_to_string(r[greatest(1, line_start - 8):least(len(r), line_end + 16)], chr(10)) AS context, summary FROM x""",
)
def manual_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol with its lines of the page and the answer's fields."""
    parsed = cut(html.parse(pages(spark, sf_dir)))
    found = catalog.lookup_symbol(None, html.entity_rows(parsed, BASE), parsed.select("url", "body"), None, BASE, "m4.S4.run")
    return found.select("found", "symbol_name", "page_url", "url_with_anchor", "kind", "line_start", "context_start", "context_end", "context", "summary")


@query("manual_entity_context", f"WITH {SUPPLIERS}, {OBJECTS} SELECT entity_id, qualname, 4::INT AS n_params, 4::INT AS n_notes FROM o WHERE name = 'S4'")
def manual_entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best class for a query, in full."""
    entities = _entities(spark, sf_dir)
    params, notes = html.child_tables(entities)
    index = catalog.entity_index(entities, notes, "simple")
    found = catalog.entity_context(index, entities.drop("params", "notes", "xrefs"), params, notes, "S4", kind="class")
    return found.select("entity_id", "qualname", F.size("params").alias("n_params"), F.size("notes").alias("n_notes"))
