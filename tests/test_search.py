import sqlite3

import pytest

from docloom.operators import chunks, search
from docloom.operators import index as ix
from docloom.operators.query import Stage

ROWS = [
    ("u1", "API page", "send_photo takes photos of running runners"),
    ("u2", "Guide", "send a photo"),
    ("u3", "photo send", "x y z photograph café"),
    ("u4", "Misc", "nothing here at all to see in this long row of words"),
    ("u5", "Other", "send photo send photo send-photo"),
]
MATCHES = ['"send_photo"', '"photo"', '"run"', '"cafe"', '"page" AND "running"', '"photo" AND ("guide" OR "words")', '"send photo" AND "send"']
STAGES = [Stage(("send_photo",)), Stage(("photo",)), Stage(("run",)), Stage(("cafe",)), Stage(("page", "running")), Stage(("photo",), ("guide", "words")), Stage(("send photo", "send"))]


@pytest.fixture(scope="module")
def index(spark):
    return ix.build(spark.createDataFrame(ROWS, ["u", "title", "chunk"]), ["u"], ["title", "chunk"])


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(u unindexed, title, chunk, tokenize='porter unicode61')")
    db.executemany("insert into t values(?, ?, ?)", ROWS)
    return db


@pytest.mark.parametrize("match,stage", zip(MATCHES, STAGES))
def test_ranks_equal_sqlite(index, fts, match, stage):
    plan = ix.Plan.of([stage], "english")
    found = {r.u: r["rank"] for r in ix.match(ix.look_up(index, plan), plan).collect()}
    want = dict(fts.execute("select u, bm25(t) from t where t match ?", (match,)).fetchall())
    assert found == pytest.approx(want, rel=1e-9)


def test_column_filter_equals_sqlite(index, fts):
    plan = ix.Plan.of([Stage(("photo",))], "english")
    found = {r.u: r["rank"] for r in ix.match(ix.look_up(index, plan, ["title"]), plan).collect()}
    assert found == pytest.approx(dict(fts.execute("select u, bm25(t) from t where t match '{title} : \"photo\"'").fetchall()))


def test_phrase_without_terms(index):
    plan = ix.Plan.of([Stage(("->", "photo")), Stage((), ("->", "photo"))], "english")
    found = ix.match(ix.look_up(index, plan), plan).collect()
    assert {r.stage for r in found} == {2} and len(found) == 4


def test_scope_does_not_change_ranks(spark, index):
    plan = ix.Plan.of([Stage(("photo",))], "english")
    scope = spark.createDataFrame([("u2",)], "u string")
    every = {r.u: r["rank"] for r in ix.match(ix.look_up(index, plan), plan).collect()}
    assert [(r.u, r["rank"]) for r in ix.match(ix.look_up(index, plan), plan, scope).collect()] == [("u2", every["u2"])]


def test_scan_and_postings_agree(spark):
    rows = spark.createDataFrame(ROWS, ["u", "title", "chunk"])
    simple = ix.build(rows, ["u"], ["title", "chunk"], "simple")
    plan = ix.Plan.of([Stage(("send photo",), ("photo", "guide"))], "simple")
    a = ix.match(ix.scan(rows, ["u"], ["title", "chunk"], plan), plan)
    b = ix.match(ix.look_up(simple, plan), plan)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 2


ROOT, OTHER = "https://docs.example/en/", "https://other.example/"


@pytest.fixture(scope="module")
def site(spark):
    lines = [f"line {i}" for i in range(1, 12)] + ["the MARKER stands here"] + [f"tail {i}" for i in range(7)]
    long = "MARKER first\n\n" + "x " * 1500 + "\n\n" + "y " * 1500 + "\n\nMARKER last"
    rows = [
        (ROOT + "page.html", "Page title", "alpha\n\nbeta UNIQUEHIT gamma\n", ROOT, 1),
        (ROOT + "lines.html", "Lines", "\n".join(lines), ROOT, 2),
        (ROOT + "long.html", "Long", long, ROOT, 3),
        (OTHER + "a.html", "Else", "beta UNIQUEHIT elsewhere", OTHER, 4),
    ]
    pages = spark.createDataFrame(rows, "url string, title string, body string, source_base string, fetched_at long")
    table = chunks.chunk(pages)
    return table, pages


@pytest.mark.parametrize("built", [False, True])
def test_search(site, built):
    table, pages = site
    index = ix.build(table, ["url", "ord"], ["title", "chunk"]) if built else None
    hits = search.search(index, table, pages, "UNIQUEHIT").collect()
    assert {(h.url, h.line) for h in hits} == {(ROOT + "page.html", 3), (OTHER + "a.html", 1)}
    scoped = search.search(index, table, pages, "uniquehit", source_base=OTHER + "x.html").collect()
    assert [h.url for h in scoped] == [OTHER + "a.html"] and scoped[0].snippet == "beta UNIQUEHIT elsewhere"
    free = search.search(index, table, pages, "where is the beta UNIQUEHIT gamma documented exactly please").collect()
    assert free[0].url == ROOT + "page.html"
    assert search.search(index, table, pages, "a the").collect() == []


def test_in_page_keeps_all_chunks(site):
    table, pages = site
    assert len(search.search_in_page(None, table, pages, ROOT + "long.html", "MARKER").collect()) >= 2
    hits = search.search(None, table, pages, "MARKER").collect()
    assert sorted(h.url for h in hits) == [ROOT + "lines.html", ROOT + "long.html"]
    assert [h.line for h in hits if h.url.endswith("lines.html")] == [12]


def test_limits(site):
    with pytest.raises(ValueError):
        search.search(None, *site, "x", limit=0)
    assert search.over_fetch(1) == 200 and search.over_fetch(100) == 1000 and search.over_fetch(100, True) == 2000
