import re

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash as sh


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints, radius):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fp = np.array(prints, np.uint64)
    for i, j in np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= radius, 1)):
        a, b = sorted((find(ids[i]), find(ids[j])))
        root[b] = a
    return [find(i) for i in ids]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect())
    found = {r.doc_id: r for r in sh.run(docs).collect()}
    ids, prints = [r.doc_id for r in rows], [plain(r.text) for r in rows]
    assert [int(found[i].fingerprint, 16) for i in ids] == prints
    assert [found[i].component_id for i in ids] == classes(ids, prints, 4)


def test_spark_hashes_shingles_alike(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


@pytest.mark.parametrize("tile,blocks", [(2048, 5), (8, 5), (16, 6), (8, 8)])
def test_links_of_crowded_cells(spark, monkeypatch, tile, blocks):
    """Chains and clusters of near fingerprints, over many tiles and choices of blocks."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(25):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints |= {0, (1 << 64) - 1, 15, 31}
    prints = sorted(prints)
    ids = list(range(len(prints)))
    monkeypatch.setattr(sh, "block_count", lambda n, r: blocks)
    table = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in zip(ids, prints)], "doc_id long, fp long")
    s = sh.Settings(tile=tile)
    found = {r.fp: r.component_id for r in sh.components(table, s=s).collect()}
    assert [found[int(np.uint64(p).astype(np.int64))] for p in prints] == classes(ids, prints, 4)


def test_block_count_grows_with_the_table():
    assert sh.block_count(1000, 4) == 5 and sh.block_count(10**9, 4) > 5
    for blocks in (5, 6, 7, 8):
        assert len(sh._cells.__code__.co_varnames) and blocks - 4 > 0


def test_awkward_rows(docs, no_docs):
    found = sh.run(docs).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[5].fingerprint == by[6].fingerprint == "0" * 16
    assert by[5].component_id == by[6].component_id == by[7].component_id == 5
    assert by[1].component_id == by[2].component_id == 1
    assert sh.run(no_docs).count() == 0


def test_keep_one(docs, no_docs):
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = [(r.doc_id, r.text) for r in docs.distinct().collect()]
    prints = [plain(t) for _, t in want]
    group = classes(list(range(len(want))), prints, 4)
    least = {}
    for g, (i, t) in zip(group, want):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _ in rows) == sorted(least.values())
    assert sh.keep_one(no_docs).count() == 0


def test_rows_without_id_bridge(spark):
    """A class without ids links its neighbours, and a component of such rows has no id."""
    prints = [(1, 0), (None, 0b1111), (5, 0b11111111), (None, -1)]
    found = {r.fp: r.component_id for r in sh.components(spark.createDataFrame(prints, "doc_id long, fp long")).collect()}
    assert found == {0: 1, 0b1111: 1, 0b11111111: 1, -1: None}
