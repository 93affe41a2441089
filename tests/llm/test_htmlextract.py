import html
import re

from docloom.llm import htmlextract as hx


def plain(page):
    """The article of a test page, by regular expression."""
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?p>|</?h1>", article)]
    return "\n".join(p for p in parts if p)


def test_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    for r in hx.run(pages).collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=1>A</a><li><a href=2>B</a></ul></nav>
<div class="cookie-notice">We use cookies to do things, please accept all of them now and then some more.</div>
<main><h1>Title &amp; more</h1><p>First   paragraph<!-- not this --> with words in it and a <a href=x>link</a>.<p>Second<br>one.<script>var a = "<p>no</p>";</script>
<form><label>Name</label><input><button>Send</button><textarea>typed</textarea></form>
<section id="comments"><p>A reader writes a long comment here that is not part of the text at all, no.</p></section></main>
<aside>Side words that nobody reads in this page at all.</aside><footer>&copy; 2020 <a href=y>Us</a></footer></body></html>"""


def test_parts_of_a_page():
    assert hx.main_text(PAGE, hx.Tree.train()) == "Title & more\nFirst paragraph with words in it and a link.\nSecond one."


def test_without_article_text_density_decides():
    page = PAGE.replace("<main>", "<div>").replace("</main>", "</div>").replace("First   paragraph", "First paragraph " + "with many words " * 8)
    found = hx.main_text(page, hx.Tree.train())
    assert "with many words" in found and "Us" not in found and "reader" not in found and "cookies" not in found


def test_attributes_are_read_whole():
    tree = hx.Tree.train()
    body = "<p>" + "Words of the article go on for quite a while here. " * 3 + "</p>"
    for mark in ('title="a hidden gem"', 'data-note="hidden"', 'data-track-id="share"', "data-hidden=false", 'data-x="class=ad"', "class='story'"):
        assert hx.main_text(f"<article {mark}>{body}{body}</article>", tree).count("quite a while") == 6, mark
    for mark in ("hidden", 'hidden=""', 'aria-hidden="true"', 'style="x:1; display: none"', 'class="big advert"', "id=comments"):
        assert hx.main_text(f"<article>{body}<div {mark}>{body}</div>{body}</article>", tree).count("quite a while") == 6, mark
    assert hx.attributes('a="1 b=2" c d = e a=7 HIDDEN') == {"a": "1 b=2", "c": "", "d": "e", "hidden": ""}
    assert "related" in hx.main_text(f'<article>{body}<p class="related work">An overview of related work by others, which is text.</p>{body}</article>', tree)
    assert hx.main_text(f'<div itemprop="articleBody">{body}</div><div>A stray remark.</div>', tree).count("\n") == 0


def test_words_and_links_decide():
    """The same marks throughout: only link density and word counts of blocks and neighbours differ."""
    tree = hx.Tree.train()
    text = "<p>" + "Words of the article go on for quite a while here. " * 3 + "</p>"
    items = ["first thing to read", "second thing", "third thing to see", "fourth thing"]
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    linked = "<ul>" + "".join(f"<li><a href=x>{x}</a></li>" for x in items) + "</ul>"
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>")):
        assert "third thing" in hx.main_text(f"{open_}{text}{listed}{text}{close}", tree)
        assert "third thing" not in hx.main_text(f"{open_}{text}{linked}{text}{close}", tree)
    plain_page = f"<body>{linked}{text}{text}{linked}</body>"
    assert hx.main_text(plain_page, tree).count("quite a while") == 6 and "thing" not in hx.main_text(plain_page, tree)
    long_box = f'<article>{text}<div class="related">{text}</div>{text}</article>'
    short_box = f'<article>{text}<div class="related">{linked}</div>{text}</article>'
    assert hx.main_text(long_box, tree).count("quite a while") == 9 and "thing" not in hx.main_text(short_box, tree)
    # The first question of the tree is one of words or links.
    assert tree.feature[0] < hx._MARKS


def test_tree_on_held_out_pages():
    tree = hx.Tree.train()
    X, y = hx.labelled(pages=200, seed=99)
    assert (tree.predict(X) == y).mean() > 0.99
    dense = X.copy()
    dense[:, 1] = 1.0
    assert (tree.predict(dense) != tree.predict(X))[y == 1].mean() > 0.9


def test_awkward_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p", "x"), (4, "u", "no markup at all", "x"), (5, "u", "<article><p>a<p>a</article>", "x"), (5, "u", "<article><p>a<p>a</article>", "x"), (6, "u", "<article>" + "<p>w &lt;b&gt;</p>" * 5000, "x"), (7, "u", "<script>never closed <p>x", "x")],
        "page_id long, url string, html string, text string",
    )
    found = hx.run(pages).collect()
    assert len(found) == 8
    by = {r.page_id: r.text for r in found}
    assert by[1] == by[2] == by[7] == "" and by[5] == "a\na" and by[6] == "\n".join(["w <b>"] * 5000)
    assert hx.extract(pages).columns == ["page_id", "url", "html", "text", "n_chars"]
    assert hx.run(pages.limit(0)).count() == 0
