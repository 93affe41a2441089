import hashlib
import re

import pytest

from docloom.llm import decontam as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, n=8):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                got = windows.get(tuple(w[a : a + k]))
                if got:
                    found |= got
                    hit |= set(range(a, a + k))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_against_brute_force(spark, sf, block):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    extra = spark.createDataFrame([(1000, "the"), (1001, "One two"), (1002, ""), (1003, None), (1004, "of the the"), (7, "and a the")], "item_id long, text string")
    bench = bench.unionByName(extra)
    rows = docs.collect()
    want = brute([r.text for r in rows], [tuple(r) for r in bench.collect()])
    found = {r.doc_id: tuple(r)[1:] for r in dc.run(docs, bench, dc.Settings(block_bytes=block)).collect()}
    assert [found[r.doc_id] for r in rows] == want
    assert any(w[4] for w in want)


def test_awkward_rows(spark, docs, no_docs):
    bench = spark.createDataFrame([(1, "shared5 passage35 shared6 passage42 shared7 passage49 shared8 passage56"), (2, "Ab"), (None, "the"), (3, None)], "item_id long, text string")
    found = {(r.doc_id, r.n_words): r for r in dc.run(docs, bench).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute([t for _, t in rows], [(1, bench.first().text), (2, "Ab")])
    assert all(tuple(found[i, w[0]])[1:] == w for (i, _), w in zip(rows, want))
    assert dc.run(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert dc.run(no_docs, bench).count() == 0
    assert dc.mark(docs, bench).columns == [*docs.columns, *[f.name for f in dc.FIELDS]]
