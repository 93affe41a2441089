import pytest

from docloom.operators.store import Store
from docloom.streaming import ingest

ROOT = "https://d.example/en/"


def page(name, extra="", returns="Other"):
    return f'<html><title>{name}</title><body><main><p>About {name}.</p><dl class="py class"><dt id="pkg.{name}">class {name}</dt><dd><p>It is similar to {returns}. <a href="o.html#pkg.Other">Other</a></p>{extra}</dd></dl></main></body></html>'


METHOD = '<dl class="py method"><dt id="pkg.A.go">go() → Other</dt><dd><p>Goes.</p></dd></dl>'


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def put(store, spark, *pages, base=ROOT):
    ingest.upsert_pages(store, spark.createDataFrame(list(pages), "url string, html string"), base, now=7)


def edges(store):
    return {(r.from_entity_id.rpartition("#")[2], r.edge_type, r.to_entity_id.rpartition("#")[2]) for r in store.read("edges").collect()}


def test_upsert_and_clear(spark, store):
    put(store, spark, (ROOT + "a.html", page("A", METHOD)))
    assert edges(store) == {("pkg.A", "has_method", "pkg.A.go")}  # Other is not there yet
    put(store, spark, (ROOT + "o.html", page("Other", returns="A")))
    ingest.rebuild_graph(store, ROOT)
    assert {("pkg.A", "references", "pkg.Other"), ("pkg.A", "similar_to", "pkg.Other"), ("pkg.Other", "similar_to", "pkg.A")} <= edges(store)
    assert ("pkg.A", "has_method", "pkg.A.go") in edges(store)
    # The page gives up its method: the entity, its edges and its chunk go.
    put(store, spark, (ROOT + "a.html", page("A").replace("About A", "Now about A")))
    assert not any("pkg.A.go" in e for row in edges(store) for e in row)
    assert store.read("entities").count() == 2 and store.read("pages").count() == 2
    assert [r.chunk for r in store.read("chunks").where(f"url = '{ROOT}a.html'").collect()][0].startswith("Now about A.")
    assert ("pkg.Other", "similar_to", "pkg.A") in edges(store)  # an edge into a page that changed stays
    put(store, spark, ("https://x.example/b.html", page("B")), base="https://x.example/")
    assert ingest.clear_source(store, ROOT + "any.html") == 2
    assert [r.url for r in store.read("pages").collect()] == ["https://x.example/b.html"]
    assert store.read("edges").count() == 0 and store.read("entities").count() == 1 and store.read("chunks").count() == 1


def test_last_writer_wins(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "c", 3), (1, "d", 4), (3, "e", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in ingest.merge(old, new, ["k"], "n").collect()) == [(1, "d", 4), (2, "b", 10), (3, "e", 1)]


def test_stream(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(ROOT + "a.html", page("A"))], "url string, html string").write.parquet(folder)
    incoming = spark.readStream.schema("url string, html string").parquet(folder)
    ingest.stream_pages(store, incoming, ROOT, str(tmp_path / "cp")).start().awaitTermination(120)
    spark.createDataFrame([(ROOT + "a.html", page("A2")), (ROOT + "o.html", page("Other"))], "url string, html string").write.mode("append").parquet(folder)
    ingest.stream_pages(store, incoming, ROOT, str(tmp_path / "cp")).start().awaitTermination(120)
    assert sorted(r.title for r in store.read("pages").collect()) == ["A2", "Other"]
    assert sorted(r.name for r in store.read("entities").collect()) == ["A2", "Other"]


def test_readers_see_whole_snapshots(spark, store):
    assert store.read("pages").count() == 0 and store.read("edges").columns[0] == "source_base"
    rows = spark.createDataFrame([("u", "a", "b", "r", 1)], "url string, title string, body string, source_base string, fetched_at long")
    for n in range(4):
        store.write("pages", rows.selectExpr("url", f"'{n}' as title", "body", "source_base", "fetched_at"))
    assert store.read("pages").first().title == "3" and len(store._snapshots("pages")) == 2


def test_a_store_is_written_without_broadcasts(spark, tmp_path, monkeypatch):
    """Its tables grow together, so none goes through the driver; the session's threshold stays as it was."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before, seen, own = [spark.conf.get(k, None) for k in keys], [], ingest.cut

    def watched(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    monkeypatch.setattr(ingest, "cut", watched)
    store = Store(spark, str(tmp_path / "store"))
    page = '<div class="rst-content"><dl class="py class"><dt id="m.A">class <span class="descname">A</span></dt><dd><p>must be used with A</p></dd></dl></div>'
    pages = spark.createDataFrame([(f"https://d.example/{i}.html", page) for i in range(3)], "url string, html string")
    ingest.upsert_pages(store, pages, "https://d.example/", 1)
    ingest.rebuild_graph(store, "https://d.example/")
    ingest.clear_source(store, "https://d.example/")
    assert len(seen) > 10 and not any("Broadcast" in plan for plan in seen)
    assert [spark.conf.get(k, None) for k in keys] == before
