import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from docloom.functions import analyze, text, urls, validate
from docloom.operators import chunks, query


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


# --- text ---------------------------------------------------------------------


@pytest.mark.parametrize("body", ["a\nb", "a\n", "", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "a\n\n b \n"])
def test_lines_are_those_of_splitlines(spark, body):
    assert one(spark, body, text.lines) == body.splitlines()


@pytest.mark.parametrize("start,end,want", [(1, 2, ("a\nb", 1, 2)), (2, 9, ("b\nc", 2, 3)), (7, 8, ("", 7, 3))])
def test_line_slice(spark, start, end, want):
    assert tuple(one(spark, "a\nb\nc\n", lambda c: text.line_slice(c, start, end))) == want


def test_line_slice_bounds():
    for bounds in ((0, 1), (3, 2), (1, 6000)):
        with pytest.raises(ValueError):
            text.line_slice(None, *bounds)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("a , b ; c", "a, b; c"),
        ("f ( x ) [ y ]", "f (x) [y]"),
        ("x=1|2", "x = 1 | 2"),
        ("name (str)-the name", "name (str) – the name"),
        ("https : //a.b", "https://a.b"),
        ("module . Class", "module.Class"),
        ("Title¶ ", "Title"),
        ("a  b", "a b"),
        ("", ""),
    ],
)
def test_inline(spark, raw, want):
    from docloom.sources import html

    assert one(spark, raw, text.inline) == want == html.normal(raw)


def test_compact_signature(spark):
    assert one(spark, "def f (x : int ) → Foo [ Bar ]", lambda c: text.inline(c, compact=True)) == "def f(x: int) → Foo[Bar]"


def test_names(spark):
    assert one(spark, "Optional[Foo | typing.List[a.b.Bar]], Foo, None", text.type_names) == ["Foo", "a.b.Bar"]
    assert one(spark, "def f(x) -> Foo[Bar]", text.return_annotation) == "Foo[Bar]"
    assert one(spark, "class a.B(Base, Mixin)", text.base_annotation) == "Base, Mixin"
    assert one(spark, "classmethod a.b.C.d(x)", text.signature_qualname) == "a.b.C.d"
    assert one(spark, "a.b.C.d", lambda c: text.relative_qualnames(c, F.lit("X"))) == ["a.b.C.X", "a.b.X", "a.X"]
    assert one(spark, "top", lambda c: text.relative_qualnames(c, F.lit("X"))) == []
    assert one(spark, "a.b", lambda c: text.relative_qualnames(c, F.lit("X.y"))) == []
    assert one(spark, "chat_member_UPDATED", text.camel) == "ChatMemberUpdated"


def test_items_and_notes(spark):
    assert tuple(one(spark, "photo(str | bytes) – what to send", text.parameter_item)) == ("photo", "str | bytes", "what to send")
    assert one(spark, "not an item!", text.parameter_item) is None
    assert tuple(one(spark, "Changed in version 2.0: now faster", text.version_note)) == ("versionchanged", "2.0", "now faster")
    assert tuple(one(spark, "Deprecated since version 3: gone", text.version_note)) == ("deprecated", "3", "gone")
    notes = spark.sql("SELECT array(named_struct('kind','versionadded','version','1.2','text','x'), named_struct('kind','','version','','text','')) AS n")
    assert notes.select(text.notes_text(F.col("n"))).first()[0] == "versionadded Added in version 1.2 x"


def test_json_list(spark):
    assert one(spark, '["a", "b"]', text.json_list) == ["a", "b"]
    assert one(spark, "{broken", text.json_list) == one(spark, None, text.json_list) == []


def test_context(spark):
    body = "\n".join(str(i) for i in range(1, 41))
    row = spark.createDataFrame([(body, 20, 20), (body, 2, 3), (body, None, None)], "b string, a int, z int").select(text.context(F.col("b"), F.col("a"), F.col("z"), F.lit("spare")).alias("c")).collect()
    assert (row[0].c.start, row[0].c.end) == (12, 36) and (row[1].c.start, row[1].c.end) == (1, 19)
    assert tuple(row[2].c) == ("spare", None, None)


# --- URLs -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url,want",
    [("https://d.example/en/latest/", "https://d.example/en/latest/"), ("https://d.example/en/latest/index.html", "https://d.example/en/latest/"), ("https://d.example/en", "https://d.example/en/"), ("https://d.example", "https://d.example/")],
)
def test_doc_root(spark, url, want):
    assert one(spark, url, urls.doc_root) == want == validate.source_base(url)


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://d.example/p.html?highlight=x#top", "https://d.example/p.html"),
        ("https://d.example/p.html?a=1&Highlight=x&b=", "https://d.example/p.html?a=1&b="),
        ("https://d.example/dir/INDEX.html", "https://d.example/dir/"),
        ("https://d.example", "https://d.example/"),
        ("https://d.example/p?q=a+b%20c&r=%7E*", "https://d.example/p?q=a+b+c&r=~%2A"),
    ],
)
def test_canonical(spark, url, want):
    from docloom.sources import html

    assert one(spark, url, urls.canonical) == want == html.canonical(url)


@pytest.mark.parametrize("url,want", [("https://d.e/en/a", True), ("https://d.e/en", True), ("https://d.e/english", False), ("http://d.e/en/a", False), ("https://x.e/en/a", False)])
def test_under_prefix(spark, url, want):
    assert one(spark, url, lambda c: urls.under_prefix(c, F.lit("https://d.e"), F.lit("/en/"))) is want


# --- analysis ------------------------------------------------------------------------------


def test_terms_equal_sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, row)")
    rng = random.Random(0)
    ends = "s es ed ing ly ness ful ation ational izer ize ator ical ement ment ion al able ible ies y e ll er eed ".split(" ")
    words = {"".join(rng.choice("bcdfglmnprstvw") + rng.choice("aeiouy") for _ in range(rng.randint(1, 4))) + rng.choice(ends) for _ in range(1500)}
    words |= set("École zażółć café naïve running ponies relational skies dying oscillators formalize adjustable 日本語 x1y2 Straße".split())
    for w in words:
        db.execute("delete from t")
        db.execute("insert into t values(?)", (w,))
        assert [r[0] for r in db.execute("select term from v")] == sorted({analyze.english(t) for t in analyze.split_tokens(w)}), w


def test_column_tokens_equal_driver_tokens(spark):
    for s in ["send_photo x-ray École 日本 a1b2, don't", "", "ÀÉ́x _ __"]:
        assert one(spark, s, analyze.tokens) == analyze.split_tokens(s)


# --- queries -----------------------------------------------------------------------------------


def test_pieces():
    assert query.pieces('foo "bar baz" qux') == (["bar baz"], ["foo", "qux"])
    assert query.pieces('a "open foo') == ([], ["open", "foo"])
    assert query.pieces("The Foo foo, (bar)!") == ([], ["Foo", "bar"])


def test_stages():
    assert query.stages("") == query.stages("   ") == query.stages("a x") == []
    first = query.stages("send_photo InputFile photo")[0].match()
    assert all(f'"{w}"' in first for w in ("send_photo", "InputFile", "photo"))
    assert query.stages("send_photo foo bar")[0] == query.Stage(("send_photo",), ("foo", "bar"))
    long = query.stages("send_photo photo URL local file caption examples")
    assert len(long) == 3 and long[0].match().count(" AND ") < 6 and " OR " in long[-1].match()
    assert query.stages('"exact words"') == [query.Stage(("exact words",))]
    assert query.primary_and_fallback("")[0] is None


def test_needles():
    assert query.needles('Foo "Bar of baz" foo') == ["foo", "bar", "of", "baz"]


# --- chunks -----------------------------------------------------------------------------------------


def test_chunk_spans():
    assert chunks.spans("alpha\n\nbeta\n\ngamma\ndelta\n") == [chunks.Span("alpha\n\nbeta\n\ngamma\ndelta", 1, 6)]
    assert chunks.spans("") == chunks.spans(" \n\n ") == [chunks.Span("", 1, 1)]


def test_long_pages_keep_every_word():
    body = "\n\n".join(["para"] * 80 + ["UNIQUEMARK"] + ["other"] * 80)
    found = chunks.spans(body * 5)
    assert any("UNIQUEMARK" in c.text for c in found) and all(len(c.text) <= 2200 for c in found)


def test_single_block_of_lines_is_packed():
    body = "\n".join(f"line number {i} of the block" for i in range(300))
    found = chunks.spans(body)
    assert len(found) > 2 and found[0].first == 1 and found[-1].last == 300
    assert all(a.last < b.first for a, b in zip(found, found[1:]))


def test_nine_line_breaks_or_more_make_a_block():
    assert "\n" in chunks.spans("\n".join("abcdefghi"))[0].text and "\n" not in chunks.spans("\n".join("abcdefghij"))[0].text


def test_hard_split():
    found = chunks.spans("x" * 5000)
    assert [len(c.text) for c in found] == [2200, 2200, 960]
    scaled = chunks.hard_split(chunks.Span("y" * 4400, 1, 11))
    assert [(c.first, c.last) for c in scaled] == [(1, 6), (6, 11), (10, 11)]
    assert math.isclose(sum(len(c.text) for c in found), 5000 + 2 * 180)


def test_chunk_table(spark):
    pages = spark.createDataFrame([("u", "T", "a\r\n\r\nb"), ("v", None, None)], "url string, title string, body string")
    assert sorted(tuple(r) for r in chunks.chunk(pages).collect()) == [("u", 0, 1, 3, "T", "a\n\nb"), ("v", 0, 1, 1, "", "")]


# --- validation ---------------------------------------------------------------------------------------


def test_validation():
    assert validate.number("limit", 100) == 100 and validate.kind(" Class ") == "class" and validate.kind("") is None
    assert validate.edge_types([" returns", "returns", ""]) == ["returns"] and validate.edge_types([]) is None
    assert validate.line_slice(None, None) is None and validate.line_slice(1, 5) == (1, 5)
    assert validate.source_base(" ") is None and validate.optional_text(" x ") == "x"
    bad = [
        lambda: validate.number("limit", 0), lambda: validate.number("pages_limit", 501), lambda: validate.number("offset", -1), lambda: validate.number("max_pages", 5001), lambda: validate.number("delay", 31),
        lambda: validate.web_url("u", "ftp://x"), lambda: validate.web_url("u", " "), lambda: validate.symbol(" "), lambda: validate.kind("module"), lambda: validate.edge_types(["likes"]),
        lambda: validate.line_slice(1, None), lambda: validate.line_slice(0, 1), lambda: validate.line_slice(5, 4), lambda: validate.line_slice(1, 5001),
    ]
    for call in bad:
        with pytest.raises(ValueError):
            call()
