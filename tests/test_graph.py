import pytest
from pyspark.sql import functions as F

from docloom.functions import schema
from docloom.operators import catalog, graph

CANDIDATES = [
    (1, "b", "", "a1", "X"), (2, "b", "u1", "a2", "Y"), (3, "b", "", "", "p.Z"), (4, "b", "", "", "W"), (5, "b", "", "", "dup"),
    (6, "b", "", "", "none"), (7, "c", "u1", "a1", "W"), (8, "b", "u9", "a9", "p.W"), (9, "b", "u2", "", "n1"), (10, "b", "u1", "a1", "p.Z"),
]
ENTITIES = [
    ("b", "e1", "u1", "a1", "n1", "q1"), ("b", "e2", "u1", "a2", "n2", "q2"), ("b", "e3", "u2", "a3", "Z", "p.Z"), ("b", "e4", "u2", "a4", "W", "p.W"),
    ("b", "e5", "u2", "a5", "dup", "p.dup"), ("b", "e6", "u2", "a6", "dup", "r.dup"), ("b", "e7", "u3", None, "noanchor", "p.noanchor"),
]


@pytest.fixture(scope="module")
def tables(spark):
    c = spark.createDataFrame(CANDIDATES, "cid long, source_base string, target_url string, target_anchor string, target_name string")
    e = spark.createDataFrame(ENTITIES, "source_base string, entity_id string, page_url string, anchor string, name string, qualname string")
    return c, e


def test_resolution(tables):
    c, e = tables
    assert sorted(tuple(r) for r in graph.resolved_pairs(c, e).collect()) == [(1, "e1"), (2, "e2"), (3, "e3"), (4, "e4"), (8, "e4"), (9, "e1"), (10, "e1"), (10, "e3")]
    assert sorted(r.cid for r in graph.unresolved(c, e).collect()) == [5, 6, 7]
    assert [tuple(r) for r in graph.top_unresolved(c, e).collect()] == [("a1", 1), ("dup", 1), ("none", 1)]


def entity(i, kind="class", name="N", qualname="", signature="", parent=None, base="r", page="p1", body="", line=1):
    return (i, base, page, None, kind, name, qualname, signature, "sum " + i, body, parent, line, line)


@pytest.fixture(scope="module")
def symbols(spark):
    rows = [
        entity("bot", name="Bot", qualname="pkg.Bot", signature="class Bot(Base, object)", body="Bot can only be used in Chat. It is similar to base."),
        entity("base", name="Base", qualname="pkg.Base", signature="class Base"),
        entity("send", "method", "send", "pkg.Bot.send", "send(photo) → Optional[Message]", "bot", body="See from_user_x."),
        entity("msg", name="Message", qualname="pkg.Message", signature="class Message(text)", page="p2"),
        entity("inner", name="Inner", qualname="pkg.Bot.Inner"),
        entity("inner2", name="Inner", qualname="other.Inner"),
        entity("get", "method", "get", "pkg.Bot.get", "get() -> Inner", "bot"),
        entity("chat", name="Chat", qualname="pkg.Chat"),
        entity("far", name="Message", qualname="far.Message", base="other"),
        entity("user", name="UserX", qualname=""),
    ]
    return spark.createDataFrame(rows, schema.ENTITIES)


@pytest.fixture(scope="module")
def params(spark):
    rows = [("send", 0, "photo", "Message | str | list[Chat]", "", "d"), ("send", 1, "again", "Message", "", ""), ("get", 0, "x", "Nowhere", "", "")]
    return spark.createDataFrame(rows, schema.PARAMS)


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([("send", 0, "note", "", "must be used with Base")], schema.NOTES)


def ends(df):
    return sorted((r.from_entity_id, r.to_entity_id) for r in df.collect())


def test_signature_edges(symbols, params):
    assert ends(graph.has_method(symbols)) == [("bot", "get"), ("bot", "send")]
    assert ends(graph.returns(symbols)) == [("get", "inner"), ("send", "msg")]
    assert ends(graph.inherits_from(symbols)) == [("bot", "base")]
    found = graph.accepts_parameter_type(symbols, params).collect()
    assert sorted((r.to_entity_id, r.param_name, r.snippet) for r in found) == [("chat", "photo", "Message | str | list[Chat]"), ("msg", "again", "Message"), ("msg", "photo", "Message | str | list[Chat]")]
    assert {r.source_kind for r in found} == {"signature"} and {r.confidence for r in found} == {1.0}


def test_resolution_of_names(spark, symbols):
    refs = spark.createDataFrame([("r", "pkg.Bot.get", s) for s in ("pkg.Chat", "Chat", "Inner", "Nope", "str", "", "Message")] + [("other", "x", "Message"), ("r", "zzz", "Inner")], "source_base string, current string, symbol string")
    found = {(r.source_base, r.current, r.symbol): r.target for r in graph.resolve(refs, symbols).collect()}
    assert found == {("r", "pkg.Bot.get", "pkg.Chat"): "chat", ("r", "pkg.Bot.get", "Chat"): "chat", ("r", "pkg.Bot.get", "Inner"): "inner", ("r", "pkg.Bot.get", "Message"): "msg", ("other", "x", "Message"): "far"}


def test_text_candidates(symbols, notes):
    found = {(r.from_entity_id, r.edge_type, r.target_name, r.confidence) for r in graph.text_candidates(symbols, notes).collect()}
    assert found == {("bot", "only_valid_in", "Chat", 0.7), ("bot", "similar_to", "base", 0.65), ("send", "converts_to", "UserX", 0.6), ("send", "requires", "Base", 0.7)}


def test_sentences():
    text = "First. You can use Foo.Bar instead of it here.\nThen more"
    (kind, name, said, sure), *rest = graph.mentions(text)
    assert (kind, name, sure, rest) == ("use_instead", "Foo.Bar", 0.75, []) and said == "You can use Foo.Bar instead of it here."
    assert graph.mentions("converted to X " + "y" * 400)[0][2].startswith("converted to X y")


def test_build_and_neighbours(symbols, params, notes):
    edges, candidates = graph.build(symbols, params, notes)
    rows = {(r.from_entity_id, r.edge_type, r.to_entity_id, r.source_kind) for r in edges.collect()}
    assert ("bot", "only_valid_in", "chat", "text_inference") in rows and ("send", "requires", "base", "text_inference") in rows and ("send", "converts_to", "user", "text_inference") in rows
    assert graph.unresolved(candidates.withColumn("cid", F.monotonically_increasing_id()), symbols).count() == 1
    out = [(r.edge_type, r.to_entity_id) for r in graph.neighbours(edges, "bot").collect()]
    assert out == sorted(out) and ("has_method", "send") in out
    assert [r.from_entity_id for r in graph.neighbours(edges, "base", "in", "inherits_from").collect()] == ["bot"]
    assert graph.neighbours(edges, "bot", limit=1).count() == 1 and graph.edges_between(edges, "bot", "base").count() == 1
    near = graph.related(edges, symbols, "send").collect()
    labels = {(r.direction, r.relation_label, r.target.entity_id) for r in near}
    assert ("in", "method_of", "bot") in labels and ("out", "returns", "msg") in labels
    turns = [{"structure": 0, "signature": 0, "xref": 1, "text_inference": 2}[r.source_kind] for r in near]
    assert turns == sorted(turns)
    only = graph.related(edges, symbols, "msg", ["returns"], "in").collect()
    assert [(r.relation_label, r.target.entity_id) for r in only] == [("returned_by", "send")]
    with pytest.raises(ValueError):
        graph.related(edges, symbols, "msg", direction="up")
    said = {r.direction: r.relations for r in graph.compact_related(edges, symbols, "bot").collect()}
    assert said["out"][:2] == ["pkg.Bot has_method pkg.Bot.get", "pkg.Bot has_method pkg.Bot.send"] and all("inherits_from" not in s for s in said["out"])
    lonely = edges.where("to_entity_id != 'msg'").unionByName(edges.limit(1).withColumn("to_entity_id", F.lit("gone")))
    assert graph.stale_edges(lonely, symbols).count() == 1


def test_unique_rows(spark):
    rows = [("r", "a", "b", "t", "s", "", c, "x", "p", n, None) for c, n in ((0.5, 1), (0.9, 1), (0.5, None), (0.5, None))]
    found = graph.unique_edges(spark.createDataFrame(rows, schema.EDGES)).collect()
    assert sorted((r.confidence, r.line_start or 0) for r in found) == [(0.5, 0), (0.9, 1)]


def test_links_of_entities(spark):
    rows = [("r", "p", "e", 1, 1, [("references", "", "u", "a", "n", "s", 0.0), ("references", "xref", "u", "a", "n", "s", None), ("see_also", "xref", None, "b", None, None, 0.4)])]
    table = spark.createDataFrame(rows, "source_base string, page_url string, entity_id string, line_start int, line_end int, xrefs array<struct<edge_type string, source_kind string, target_url string, target_anchor string, target_name string, snippet string, confidence double>>")
    found = sorted((r.edge_type, r.target_url, r.confidence) for r in graph.link_candidates(table).collect())
    assert found == [("references", "u", 1.0), ("see_also", "", 0.4)]


def test_stats(spark, symbols, params, notes):
    edges, candidates = graph.build(symbols, params, notes)
    pages = spark.createDataFrame([("p1", "t", "body", "r", 1)], "url string, title string, body string, source_base string, fetched_at long")
    row = graph.stats(pages, symbols, edges, candidates, "r").first()
    assert row.pages == 1 and row.entities == 9 and row.unresolved == 1 and row.stale_edges == 0
    assert row.edges_by_type["has_method"] == 2 and row.edges_by_source["text_inference"] == 3 and [tuple(t) for t in row.top_unresolved] == [("base", 1)]


# --- catalog ------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("p1", "One", "\n".join(f"l{i}" for i in range(1, 30)), "r", 5), ("p2", "Two", "x", "r", 9), ("q1", "Q", "", "other", 1)]
    return spark.createDataFrame(rows, "url string, title string, body string, source_base string, fetched_at long")


def test_listings(pages):
    assert [tuple(r) for r in catalog.list_sources(pages).collect()] == [("other", 1, 1), ("r", 2, 9)]
    assert [r.url for r in catalog.list_pages(pages, limit=1, offset=1).collect()] == ["p2"]
    assert catalog.count_pages(pages, url_contains="p").first().total == 2 and catalog.count_pages(pages, "r", "1").first().total == 1
    assert catalog.get_page(pages, "p2").first().title == "Two"
    assert '"total_pages":3' in catalog.status(pages).first().json


def test_fetch(pages):
    row = catalog.fetch_page(pages, "p1", 2, 3).first()
    assert (row.found, row.text, row.start, row.end, row.total_lines) == (True, "l2\nl3", 2, 3, 29)
    assert catalog.fetch_page(pages, "p2").first().text == "x"
    gone = catalog.fetch_page(pages, "nope").first()
    assert gone.found is False and gone.url == "nope" and gone.text is None


def test_entity_search(symbols, notes):
    index = catalog.entity_index(symbols, notes)
    assert [r.entity_id for r in catalog.search_entities(index, symbols, "send", kind="method").collect()] == ["send"]
    assert catalog.search_entities(index, symbols, "must").count() == 0  # notes are not searched
    assert {r.entity_id for r in catalog.search_entities(index, symbols, "messages").collect()} == {"msg", "far", "send"}
    assert catalog.search_entities(index, symbols, "the").count() == 0


def test_details(symbols, params, notes):
    row = catalog.get_entity(symbols, params, notes, "bot").first()
    assert [m.name for m in row.methods] == ["get", "send"] and row.params == [] and [p.name for p in row.methods[1].params] == ["photo", "again"]
    assert [n.text for n in catalog.get_entity(symbols, params, notes, "send", methods=False).first().notes] == ["must be used with Base"]
    index = catalog.entity_index(symbols, notes)
    assert catalog.entity_context(index, symbols, params, notes, "pkg.Bot.send").first().entity_id == "send"


def test_classes(symbols):
    assert [r.entity_id for r in catalog.class_methods(symbols, class_name="Bot").collect()] == ["get", "send"]
    assert [r.entity_id for r in catalog.class_methods(symbols, "bot").collect()] == ["get", "send"]
    assert catalog.find_class(symbols, "Inner").first().entity_id == "inner2" and catalog.find_class(symbols, "Message", "other").first().entity_id == "far"
    assert catalog.class_methods(symbols, class_name="Nope").count() == 0


def test_lookup(spark, symbols, pages, params, notes):
    edges, _ = graph.build(symbols, params, notes)
    index = catalog.entity_index(symbols, notes)
    row = catalog.lookup_symbol(index, symbols, pages, edges, "r", "Message").first()
    assert row.found and row.entity_id == "msg" and row.symbol_name == "pkg.Message" and row.context == "x"
    bot = catalog.lookup_symbol(index, symbols, pages, edges, "r", "pkg.Bot", related=True).first()
    assert (bot.context_start, bot.context_end) == (1, 17) and "pkg.Bot has_method pkg.Bot.send" in bot.related["out"]
    assert catalog.lookup_symbol(index, symbols, pages, edges, "r", "sending").first().entity_id == "send"  # by search
    gone = catalog.lookup_symbol(index, symbols, pages, edges, "r", "zzz qqq").first()
    assert gone.found is False and gone.symbol_name == "zzz qqq" and gone.entity_id is None
    wanted = spark.createDataFrame([("r", "Bot"), ("r", "pkg.Bot"), ("r", "Inner"), ("r", "none")], "source_base string, symbol string")
    assert {r.symbol: (r.tier, r.entity_id) for r in catalog.lookup_symbols(symbols, wanted).collect()} == {"Bot": (2, "bot"), "pkg.Bot": (0, "bot"), "Inner": (2, "inner2")}
