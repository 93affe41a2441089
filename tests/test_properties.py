from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions import analyze, validate
from docloom.operators import chunks, query
from docloom.sources import crawl, html

prose = st.text(alphabet=st.sampled_from("ab \n\t.é\r -_\"'"), max_size=6000)


@settings(max_examples=150, deadline=None)
@given(prose)
def test_chunks_hold_the_text(body):
    found = chunks.spans(body)
    assert found and all(len(c.text) <= 2200 for c in found)
    assert all(1 <= c.first <= c.last <= max(1, len(body.splitlines())) for c in found)
    assert [c.first for c in found] == sorted(c.first for c in found)
    squeezed = lambda t: "".join(t.split())
    if all(len(c.text) < 2000 for c in found):  # no piece overlaps another
        assert squeezed("".join(c.text for c in found)) == squeezed(body)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from('abcdefgXY_.1 "\'()'), max_size=200))
def test_stages_are_bounded_and_distinct(text):
    found = query.stages(text)
    assert len(found) <= 3 and len(set(found)) == len(found)
    phrases, tokens = query.pieces(text)
    for s in found:
        assert s.every or s.some
        assert len(s.some) <= 20 and set(s.every) | set(s.some) <= set(phrases) | set(tokens)
        assert s.match().count('"') % 2 == 0
    assert bool(found) == bool(phrases or tokens)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/dlpy=\"' class&;!-ab\n"), max_size=400))
def test_any_markup_is_read(page):
    title, body, toc, found = html.read_page(page, "https://d.example/x")
    assert isinstance(title, str) and isinstance(body, str) and toc == [] or found is not None
    crawl.locations(page)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_stems_and_roots_never_fail(text):
    for t in analyze.split_tokens(text):
        assert len(analyze.english(t)) <= len(t) + 1
    root = validate.source_base(f"https://h.example/{text.replace('#', '').replace('?', '')}")
    assert root == validate.source_base(root) and root.endswith("/")
