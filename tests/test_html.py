from docloom.sources import crawl, html

URL = "https://d.example/en/api.html"

PAGE = """<html><head><title>API</title><script>no()</script></head><body><div class="rst-content"><section id="api"><h1>API<a class="headerlink" href="#api">¶</a></h1>
<p>Lead <em>text</em> , here .</p>
<section id="inner"><h2>Inner</h2><p>Inner lead.</p><pre>code
  kept</pre><ul><li>one</li><li><p>two</p><ul><li>deep</li></ul></li></ul></section><section><h2>No id</h2></section></section>
<dl class="py class"><dt class="sig" id="pkg.Bot"><em class="property">class</em> <span class="sig-name descname"><span class="pre">Bot</span></span>(<em class="sig-param">token: str</em>, <em class="sig-param">*args</em>, <em class="sig-param">x=5</em>)</dt>
<dd><p>A bot. See <a href="other.html#pkg.Chat">Chat</a>.</p>
<dl class="field-list"><dt>Parameters</dt><dd><ul><li>token (str) – the token</li><li>extra (int) - more</li></ul></dd><dt>Returns:</dt><dd><p>A thing</p></dd></dl>
<div class="admonition note"><p class="admonition-title">Note</p><p>Mind <a href="#pkg.Mind">this</a>.</p></div>
<div class="warning"><p>Careful <a href="#pkg.Care">here</a></p></div>
<div class="versionadded"><p>Added in version 2.1: the bot</p></div>
<p>Changed in version 3.0: faster</p>
<p>Deprecated since version 4: use <a href="x.html">nothing</a></p>
<div class="seealso"><p><a href="index.html?highlight=q#top">Top</a></p></div>
<dl class="py method"><dt id="pkg.Bot.send">async <span class="descname">send</span>(<em class="sig-param">photo: InputFile = None</em>) → Message</dt><dd><p>Sends. must be used with Chat. <a href="#pkg.Bot">Bot</a></p></dd></dl>
</dd></dl></div></body></html>"""


def read():
    return html.read_page(PAGE, URL)


def test_title_and_text():
    title, body, _, _ = read()
    assert title == "API"
    blocks = body.split("\n\n")
    assert blocks[:2] == ["API", "Lead text, here."]
    assert "code\n  kept" in body and "no()" not in body and "¶" not in body
    assert ["one", "two", "deep"] == [b for b in blocks if b in ("one", "two", "deep")]
    assert "class Bot(token: str, *args, x = 5)" in blocks
    assert "Parameters:\ntoken(str) – the token\nextra(int) – more\nReturns:\nA thing" in body


def test_contents():
    _, _, toc, _ = read()
    assert toc == [{"id": "api", "title": "API", "summary": "Lead text, here.", "level": 1, "url": URL + "#api", "children": [{"id": "inner", "title": "Inner", "summary": "Inner lead.", "level": 2, "url": URL + "#inner", "children": []}]}]


def test_entities():
    _, body, _, found = read()
    bot, send = found
    assert (bot["kind"], bot["name"], bot["qualname"], bot["parent_local_id"]) == ("class", "Bot", "pkg.Bot", None)
    assert (send["kind"], send["name"], send["parent_local_id"], send["signature"]) == ("method", "send", "pkg.Bot", "async send(photo: InputFile = None) → Message")
    assert [(p["ord"], p["name"], p["type"], p["default"], p["description"]) for p in bot["params"]] == [(0, "token", "str", "", "the token"), (1, "args", "", "", ""), (2, "x", "", "5", ""), (3, "extra", "int", "", "more")]
    assert send["params"] == [{"ord": 0, "name": "photo", "type": "InputFile", "default": "None", "description": ""}]
    assert bot["summary"].startswith("A bot.") and "Sends" not in bot["body_text"] and "Sends" in send["body_text"]
    assert body.splitlines()[bot["line_start"] - 1] == bot["signature"] and send["line_start"] > bot["line_start"]


def test_notes():
    bot = read()[3][0]
    assert [(n["kind"], n["version"], n["text"]) for n in bot["notes"]] == [
        ("note", "", "Note Mind this."),
        ("warning", "", "Careful here"),
        ("versionadded", "2.1", "the bot"),
        ("versionchanged", "3.0", "faster"),
        ("deprecated", "4", "use nothing"),
    ]


def test_links():
    bot, send = read()[3]
    kinds = {(x["edge_type"], x["target_url"], x["target_anchor"]) for x in bot["xrefs"]}
    assert kinds == {
        ("references", "https://d.example/en/other.html", "pkg.Chat"),
        ("mentioned_in_note", URL, "pkg.Mind"),
        ("mentioned_in_warning", URL, "pkg.Care"),
        ("see_also", "https://d.example/en/", "top"),
    }
    assert [(x["target_anchor"], x["target_name"]) for x in send["xrefs"]] == [("pkg.Bot", "Bot")]


def test_see_also_forms():
    page = '<body><dl class="py class"><dt id="A">A</dt><dd><p>See also: <a href="#x">x</a></p><dl><dt>See also</dt><dd><a href="#y">y</a></dd></dl><div class="admonition"><p class="admonition-title">See also</p><a href="#z">z</a></div></dd></dl></body>'
    assert {(x["edge_type"], x["target_anchor"]) for x in html.read_page(page, URL)[3][0]["xrefs"]} == {("see_also", c) for c in "xyz"}


def test_main_content_order():
    page = "<body><article>second</article><div class='document'>first</div></body>"
    assert html.read_page(page, URL)[1] == "first"
    assert html.read_page("<article>a</article><p>b</p>", URL)[1] == "a"
    assert html.read_page("only text", URL)[:2] == ("/en/api.html", "only text")


def test_table_function(spark):
    pages = spark.createDataFrame([(URL, PAGE), ("https://d.example/en/b.html", None), ("https://d.example/en/c.html", "<p><b>open <ul><li>x")], "url string, html string")
    parsed = html.parse(pages)
    assert parsed.count() == 3
    rows = html.entity_rows(parsed, "https://d.example/en/")
    ids = {r.entity_id: r.parent_entity_id for r in rows.collect()}
    assert ids == {URL + "#pkg.Bot": None, URL + "#pkg.Bot.send": URL + "#pkg.Bot"}
    params, notes = html.child_tables(rows)
    assert params.count() == 5 and notes.count() == 5
    assert [(r.path, r.level, r.id) for r in html.toc_rows(parsed).orderBy("path").collect()] == [("0", 1, "api"), ("0.0", 2, "inner")]
    toc = html.page_rows(parsed, "r", 7).where("title = 'API'").selectExpr("variant_get(toc, '$[0].children[0].id', 'string') AS id", "fetched_at").first()
    assert tuple(toc) == ("inner", 7)


def test_links_of_a_page(spark):
    page = '<a href="b.html#x">b</a><a class="q" href=\'/en/c/?a=1&amp;b=2\'>c</a><a href="/fr/d.html">d</a><a href="https://x.example/">e</a><a href="f.pdf">f</a><a href="mailto:x@y">m</a><link rel="next" href="g.html"><link rel="stylesheet" href="h.html">'
    pages = spark.createDataFrame([(URL, page)], "url string, html string")
    from pyspark.sql import functions as F

    found = crawl.same_site_links(pages, F.lit("https://d.example"), F.lit("/en/"))
    assert [r.link for r in found.orderBy("pos").collect()] == ["https://d.example/en/b.html", "https://d.example/en/c/?a=1&b=2", "https://d.example/en/g.html"]


def test_sitemaps(spark):
    assert crawl.locations("<urlset xmlns='http://s'><url><loc> a </loc></url><url><loc/></url></urlset>") == [("a", False)]
    assert crawl.locations(b"<sitemapindex><sitemap><loc>m</loc></sitemap></sitemapindex>") == [("m", True)]
    assert crawl.locations("<broken") == crawl.locations(None) == []
    maps = spark.createDataFrame([("<urlset><url><loc>https://d.example/en/a.html</loc></url><url><loc>https://d.example/en/a.html?highlight=x</loc></url><url><loc>https://x.example/</loc></url></urlset>",)], "xml string")
    assert [r.loc for r in crawl.sitemap_seeds(maps, "https://d.example", "/en/", 9).collect()] == ["https://d.example/en/a.html"]


def test_crawl(spark):
    site = {
        "https://d.example/en/": '<a href="a.html">a</a><a href="b.html">b</a><a href="gone.html">g</a>',
        "https://d.example/en/a.html": '<a href="c.html?highlight=q">c</a><a href="/">out</a>',
        "https://d.example/en/b.html": '<a href="index.html">home</a><a href="file.html">f</a><a href="data">d</a>',
        "https://d.example/en/c.html": "end",
        "https://d.example/en/map.html": "from the sitemap",
    }
    stored = spark.createDataFrame([(u, 200, "text/html", h) for u, h in site.items()] + [("https://d.example/en/file.html", 200, "image/png", ""), ("https://d.example/en/data", 200, "text/csv", "")], "url string, status int, content_type string, html string")
    fetch = lambda urls: stored.join(urls, "url", "left_semi")
    sitemap = spark.createDataFrame([("https://d.example/en/map.html",), ("https://x.example/z",)], "loc string")
    pages, counts = crawl.crawl("https://d.example/en/index.html", fetch, spark, 50, sitemap)
    # By its type or by its name a page.
    assert {r.url for r in pages.collect()} == set(site) | {"https://d.example/en/file.html"}
    assert tuple(counts.first()) == (6, 1, 1)
    few, counts = crawl.crawl("https://d.example/en/", fetch, spark, 2)
    assert few.count() == 2 and counts.first().fetched == 2


def test_crawl_takes_pages_first_in_first_out(spark):
    """Against a queue, one page at a time, with pages that fail, a sitemap and limits that bind."""
    import random
    from collections import deque

    rng = random.Random(4)
    base = "https://d.example/en/"
    names = [f"{base}{c}.html" for c in "qwertyuiopasdfghjkl"]
    site = {base: rng.sample(names, 3), **{n: rng.sample(names, rng.randint(0, 4)) for n in names if rng.random() < 0.8}}
    listed = rng.sample(names, 6)
    rows = [(u, 200, "text/html", "".join(f'<a href="{x}">x</a>' for x in links)) for u, links in site.items()]
    stored = spark.createDataFrame(rows, "url string, status int, content_type string, html string")
    sitemap = spark.createDataFrame([(u,) for u in listed], "loc string").coalesce(1)

    def one_by_one(limit, requests):
        queue, seen, kept = deque([base]), {base}, []
        asked = 0
        while queue and len(kept) < limit and asked < requests:
            url = queue.popleft()
            asked += 1
            if url in site:
                kept.append(url)
                for link in site[url]:
                    if link not in seen:
                        seen.add(link)
                        queue.append(link)
            if asked == 1:
                for link in listed:
                    if link not in seen:
                        seen.add(link)
                        queue.append(link)
        return kept

    for limit, requests in ((1, 99), (5, 99), (9, 99), (50, 99), (50, 7)):
        pages, _ = crawl.crawl(base, lambda urls: stored.join(urls, "url", "left_semi"), spark, limit, sitemap, requests)
        assert [r.url for r in pages.collect()] == one_by_one(limit, requests), limit


def test_frontier_has_no_depth_limit(spark):
    links = spark.createDataFrame([(i, i + 1, 0) for i in range(60)], "page long, target long, pos int")
    found = crawl.frontier(links, 0)
    assert found.count() == 61 and found.agg({"depth": "max"}).first()[0] == 60
    assert crawl.frontier(links, 0, max_depth=5).count() == 6


def test_frontier_is_breadth_first(spark):
    links = spark.createDataFrame([(0, 2, 0), (0, 1, 1), (1, 3, 0), (2, 4, 0), (2, 3, 1), (3, 0, 0), (4, 5, 0)], "page long, target long, pos int")
    found = crawl.frontier(links, 0).orderBy("depth", "found_at").collect()
    assert [(r.page, r.depth) for r in found] == [(0, 0), (2, 1), (1, 1), (4, 2), (3, 2), (5, 3)]
    assert crawl.frontier(links, 0, max_pages=3).count() == 3


def test_pages_that_were_read_are_freed(monkeypatch):
    """Trees know their parents; none waits for Python to look for cycles."""
    import gc
    import weakref

    trees, own = [], html.tree

    def watched(page):
        root = own(page)
        trees.append(weakref.ref(root.elements[0]))
        return root

    monkeypatch.setattr(html, "tree", watched)
    gc.disable()
    try:
        html.read_page("<main><p>one</p><dl class='py class'><dt id='a'>class a</dt><dd>b</dd></dl></main>", "https://d.example/x")
        assert [t() for t in trees] == [None]
    finally:
        gc.enable()


def test_python_gets_small_batches(spark):
    """Batches are bounded in bytes, and so few pages are held read at a time."""
    pages = spark.range(1).select(html.F.lit("https://d.example/x").alias("url"), html.F.lit("<p>x</p>").alias("html"))
    html.parse(pages)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
