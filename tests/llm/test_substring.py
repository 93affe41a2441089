import hashlib
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import substring as ss


def brute(texts, n, keep_first=False):
    """(bytes, removed, spans, kept) of each text, by all windows."""
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            places[t[i : i + n]].append((d, i))
    marks = [np.zeros(len(t) + 1, bool) for t in texts]
    for at in places.values():
        for k, (d, i) in enumerate(at):
            if len(at) > 1 and not (keep_first and k == 0):
                marks[d][i : i + n] = True
    out = []
    for t, m in zip(texts, marks):
        kept = bytes(np.frombuffer(t, np.uint8)[~m[:-1]])
        out.append((len(t), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("s", [ss.Settings(), ss.Settings(group=1), ss.Settings(length=60, gram=20, group=3), ss.Settings(length=30, gram=30), ss.Settings(length=16, gram=3, group=2)])
def test_against_brute_force(spark, sf, s):
    table = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000")
    texts = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    ids = sorted(texts)
    want = {i: (a, b, c, hashlib.sha256(k).hexdigest()) for i, (a, b, c, k) in zip(ids, brute([texts[i] for i in ids], s.length))}
    assert {r.doc_id: tuple(r)[1:] for r in ss.run(table, s).collect()} == want


def test_planted_passage(spark):
    rng = np.random.default_rng(0)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage, run = word(450), "ab" * 400
    texts = [word(300) + passage + word(200), passage[:430] + word(77), word(600), run, word(10), passage[30:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in brute([t.encode() for t in texts], 400)]
    assert [tuple(r)[1:] for r in sorted(ss.run(docs).collect())] == want
    assert want[3][1] == 800  # a text repeats itself


def test_keep_first(spark, sf):
    s = ss.Settings(length=60, gram=20, group=4, keep_first=True)
    table = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    order = [r.doc_id for r in ss._doc_keys(table, "doc_id", "text").orderBy("__d", "__t").collect()]
    want = {i: k.decode("utf-8", "ignore") for i, (_, _, _, k) in zip(order, brute([texts[i].encode() for i in order], s.length, True))}
    assert {r.doc_id: r.text for r in ss.dedup(table, s=s).collect()} == want


def test_long_rows_are_cut_into_pieces():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 3 * ss._CHUNK // 2).astype(np.uint8)
    row, x, lo, hi, key, whole = ss.segments(data, np.array([0, len(data)]), ss.Settings())
    covered = np.zeros(len(data), bool)
    for a, b in zip(lo, hi):
        covered[a : b + 1] = True
    assert covered[: len(data) - 399].all() and not covered[len(data) - 399 :].any()
    assert ((lo <= x) & (hi <= x) & (x - lo <= 300)).all()


def test_ranks_order_windows():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    found = ss.ranks(data, 5)
    windows = [bytes(data[i : i + 5]) for i in range(len(data) - 4)]
    order = sorted(set(windows))
    assert found.tolist() == [order.index(w) for w in windows]


def test_awkward_rows(docs, no_docs):
    found = sorted(ss.run(docs).collect(), key=str)
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    assert by[6].n_bytes == 0 and by[5].n_removed == 0 and by[8].n_removed > 100_000
    assert ss.run(no_docs).count() == 0
    kept = ss.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_bounds():
    with pytest.raises(ValueError):
        ss.Settings(length=5000)
