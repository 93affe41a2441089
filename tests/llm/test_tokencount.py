import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import tokencount as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return tc.PrefixCounter(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, docs, sf, library):
    for table in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        found = tc.run(table, PATH).collect()
        texts = [r.text or "" for r in table.select("text").collect()]
        want = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
        assert sorted((r.n_bytes, r.n_tokens) for r in found) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in found)


def test_every_prefix_equals_the_library(counter, library):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "'re", "'ll", "é", "ß", "1", "!!", "<|endoftext|>", "the", " of", "日本", "😀", "\t", " ", "<|end"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, text


def test_table_is_the_plain_encoding(counter):
    for piece in (b"hello", b" international", b"xqzwvk", "日本語".encode(), b"aaaaaaaaaaaaaaaaaaaa"):
        assert counter.table(piece) == [len(counter.encode(piece[:i])) for i in range(len(piece) + 1)]


def test_budget(spark, docs, counter, library):
    found = tc.fit_to_budget(docs.where("doc_id in (1, 10, 5, 6)"), PATH, 5, keep=["doc_id", "text"]).collect()
    for r in found:
        text = r.text or ""
        fits = [k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= 5]
        assert r.prefix_chars == max(fits)


def test_memory_is_bounded_and_exact(library):
    small = tc.PrefixCounter(open(PATH, "rb").read(), tc.Settings(remembered=4))
    text = "one two three four five six seven eight nine ten " * 3
    assert small.count(text) == len(library.encode(text, add_special_tokens=False).ids) and len(small._known) <= 4


def test_empty_table(no_docs):
    assert tc.run(no_docs, PATH).collect() == []
