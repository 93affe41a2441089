import pytest

from pyspark.sql import functions as F

from docloom.api import Engine

ROOT = "https://d.example/en/"
SITE = {
    ROOT: '<title>Home</title><main><p>Welcome home.</p><a href="bot.html">bot</a></main>',
    ROOT + "bot.html": '<title>Bot</title><main><p>The bot sends UNIQUE photos.</p><dl class="py class"><dt id="pkg.Bot">class Bot</dt><dd><p>A bot.</p>'
    '<dl class="py method"><dt id="pkg.Bot.send">send(<em class="sig-param">chat: Chat</em>) → Bot</dt><dd><p>Sends photos.</p></dd></dl></dd></dl>'
    '<dl class="py class"><dt id="pkg.Chat">class Chat</dt><dd><p>Use with <a href="#pkg.Bot">Bot</a>.</p></dd></dl></main>',
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine.open(spark, str(tmp_path_factory.mktemp("store")))
    stored = spark.createDataFrame([(u, 200, "text/html", h) for u, h in SITE.items()], "url string, status int, content_type string, html string")
    counters = made.index_site(ROOT, lambda urls: stored.join(urls, "url", "left_semi"))
    assert tuple(counters.first()) == (2, 0, 0)
    return made


def test_pages(engine):
    assert [h.url for h in engine.search("UNIQUE").collect()] == [ROOT + "bot.html"]
    assert engine.search_in_file(ROOT + "bot.html", "photos").count() == 1
    assert engine.fetch(ROOT, 1, 1).first().text == "Welcome home."
    assert [p.title for p in engine.list_documentation_pages(ROOT).collect()] == ["Home", "Bot"]
    assert engine.list_indexed_sources().first().page_count == 2 and ROOT in engine.index_status().first().json


def test_symbols(engine):
    assert engine.search_entities("send", kind="method").first().qualname == "pkg.Bot.send"
    row = engine.get_entity(ROOT + "bot.html#pkg.Bot").first()
    assert [m.name for m in row.methods] == ["send"]
    assert engine.list_class_methods(class_name="Bot").first().name == "send"
    assert engine.get_entity_context("Chat").first().qualname == "pkg.Chat"
    found = engine.lookup_symbol(ROOT, "Bot", include_related=True).first()
    assert found.found and "pkg.Bot has_method pkg.Bot.send" in found.related["out"] and "pkg.Chat references pkg.Bot" in found.related["in"]
    labels = {(r.relation_label, r.target.qualname) for r in engine.related_symbols(ROOT, "pkg.Bot").collect()}
    assert labels == {("has_method", "pkg.Bot.send"), ("returned_by", "pkg.Bot.send"), ("references", "pkg.Chat")}
    assert engine.related_symbols(ROOT, "pkg.Chat", ["accepts_parameter_type"]).first().relation_label == "used_by"
    stats = engine.symbol_graph_stats(ROOT).first()
    assert (stats.pages, stats.entities, stats.stale_edges) == (2, 3, 0)


def test_bad_parameters(engine):
    for call in (lambda: engine.search("x", 0), lambda: engine.fetch("x"), lambda: engine.lookup_symbol(ROOT, " "), lambda: engine.related_symbols(ROOT, "Bot", ["likes"]), lambda: engine.fetch(ROOT, 3, 2)):
        with pytest.raises(ValueError):
            call()


def test_a_manual_is_read_once(spark, monkeypatch):
    """A query that refers to the entities again and again reads no page twice, and in as many tasks as there are cores."""
    from docloom.plans import manual
    from docloom.sources import html

    read = spark.sparkContext.accumulator(0)
    own = html.parse

    def counted(pages):
        return own(pages.where(F.udf(lambda u: (read.add(1), True)[1], "boolean")("url")))

    monkeypatch.setattr(html, "parse", counted)
    assert manual.pages(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert len(manual.manual_entity_context(spark, "/root/testdata/sf0.01").collect()) == 1
    assert read.value == spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
