import dataclasses
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from docloom.llm import simhash as sh
from docloom.llm import simhash_similar as nc
from docloom.llm.runtime import cut

SIMILAR = sh.Settings(words=5, radius=30, percent=80)


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Ids of the least document of each component of five-word Jaccard 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return out


def corpus():
    """Groups of copies with edits around and below the limit, over a line that all have."""
    rng, rows = random.Random(3), []
    for group in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(12):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 25))) + "\nthe line that stands in all of them")
    rng.shuffle(rows)
    return list(enumerate(rows + ["a b c d e f g h", "A b\tc d  e f g h", "one two", "One two", "", " \n", None]))


@pytest.mark.parametrize("nearest,tile,often", [((2, 8), 2048, 8), ((1,), 6, 2), ((2, 8), 2048, 10**6)])
def test_against_brute_force(spark, monkeypatch, nearest, tile, often):
    monkeypatch.setattr(nc, "NEAREST", nearest)
    monkeypatch.setattr(nc, "OFTEN", often)
    rows = corpus()
    kept = sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), s=dataclasses.replace(SIMILAR, tile=tile))
    assert sorted(r.doc_id for r in kept.collect()) == brute(rows)


def test_radius_loses_no_similar_pair():
    """Fingerprints of all pairs of similarity 0.8 or more in the corpus and in many short sets are within the radius."""
    rng, far = random.Random(8), []
    texts = [t for _, t in corpus()]
    for _ in range(4000):
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([9, 13, 20, 40, 100, 300]))]
        texts += [" ".join(base), " ".join(edited(rng, base, 1)), " ".join(base[: max(1, len(base) * 9 // 10)])]
    sets = list(nc.shingle_sets(pa.array(texts, pa.string()), 5))
    prints = np.array([nc._fingerprint(x) for x in sets], np.int64).view(np.uint64)
    for i in range(len(corpus()), len(sets) - 2, 3):
        for j in (i + 1, i + 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                far.append(int(np.bitwise_count(prints[i] ^ prints[j])))
    assert len(far) > 3000 and max(far) <= SIMILAR.radius, max(far)


def test_repeated_ids_and_rows_without_id(spark):
    """An id with two texts that differ keeps both; copies without an id go, but for one of each group."""
    long = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"x{i}" for i in range(80))
    rows = [(1, long), (1, other), (2, other + " end"), (None, long), (None, "alone " * 9), (None, "alone " * 9), (3, long + " more")]
    for s in (SIMILAR, sh.Settings()):
        kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), s=s).collect())
        assert [k for k in kept if k[:2] == (False, 1)] == [(False, 1, long), (False, 1, other)]
        assert [k for k in kept if k[0]] == [(True, 0, "alone " * 9)]
        if s is SIMILAR:
            assert len(kept) == 3


def test_pipeline_stage_links_at_four_fifths(spark, sf):
    """Copies that five-word shingles link and fingerprints of four within 4 bits do not."""
    words = [f"word{i}" for i in range(100)]
    other = [*words[:50], "else", *words[51:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.doc_id for r in dict(cp.STAGES)["simhash"](spark, docs, sf).collect()] == [1]


def related(rng, groups, members, words):
    """Groups of documents that share more than half of their shingles and yet are no near copies."""
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(members):
            yield " ".join(w if i % 20 else f"edit{rng.randrange(10**9)}" for i, w in enumerate(base))


def cells_of(spark, texts):
    rows = sh.named(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), "doc_id", "text")
    groups = cut(nc._marks(rows, "text", ["__id"], SIMILAR))
    cells, ends = nc._cells(groups, SIMILAR)
    return cut(cells.repartition(16)), ends, groups


def test_pairs_to_verify_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Documents that are related, but no near copies, are told apart in their cells, long ones too."""
    monkeypatch.setattr(nc, "OFTEN", 10**6)
    rng, seen, similar = random.Random(5), [], nc._similar
    texts = [*related(rng, 2, 40, 200), *related(rng, 1, 40, 6000)]
    cells, ends, groups = cells_of(spark, texts)
    assert max(r["count"] for r in cells.groupBy("cell").count().collect()) >= 30
    some = cut(nc._partnered(cells, ends, SIMILAR))
    assert 0 < some.count() <= cells.count()
    assert nc._offers(some, groups, None, 0, SIMILAR).isEmpty()
    monkeypatch.setattr(nc, "_similar", lambda rows, text_col, least, pairs, s: seen.append(pairs.count()) or similar(rows, text_col, least, pairs, s))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sh.keep_one(docs, s=SIMILAR).count() == len(texts) and sum(seen) == 0


def test_small_sieves_lose_nothing(spark, monkeypatch):
    """Sieves so full that nearly all passes give the same rows."""
    for module in (sh, nc):
        monkeypatch.setattr(module, "BUCKETS", 64)
    rows = corpus()
    kept = sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), s=SIMILAR)
    assert sorted(r.doc_id for r in kept.collect()) == brute(rows)


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(nc, "SAMPLE", 1)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.randbytes(500).hex() for _ in range(30))) for i in range(100)]
    rows.append((100, rows[3][1] + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    kept = sh.keep_one(docs, s=SIMILAR)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100))
    assert written() - before < sum(len(t) for _, t in rows) / 4


def test_labels_lose_no_pair(spark):
    """A later round reads whole cells, however the joins before it deal them: with no two classes labelled alike it finds all pairs."""
    rng = random.Random(6)
    texts = [" ".join(edited(rng, base, 1)) for base in ([f"w{rng.randrange(10**6)}" for _ in range(150)] for _ in range(40)) for _ in range(6)]
    cells, ends, groups = cells_of(spark, texts)
    labels = spark.createDataFrame([], "v long, p long")
    key = {r["__id"]: r.key for r in groups.select("__id", "key").collect()}
    sets = [shingles(t) for t in texts]
    similar = {
        (max(key[i], key[j]), min(key[i], key[j])) for i in range(len(texts)) for j in range(i) if i // 6 == j // 6 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    }
    some = cut(nc._partnered(cells, ends, SIMILAR))
    # The nearest alone, and then the rows held back, give all pairs too.
    first = cut(nc._offers(some, groups, labels, 1, SIMILAR))
    held = some.join(first.where("p is null").select("cell", F.col("v").alias("key")), ["cell", "key"], "left_semi")
    two = first.where("p is not null").unionByName(nc._offers(held, groups, labels, 0, SIMILAR))
    for table in (nc._offers(some, groups, None, 0, SIMILAR), nc._offers(some, groups, labels, 0, SIMILAR), two):
        assert len(similar) > 300 and similar <= {(r.v, r.p) for r in table.collect()}


def test_bitmaps():
    """A bitmap folds to the smaller one, and never differs in more bits than the sets do."""
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (0, 3, 400, 700, 5000)] + [rng.integers(0, 1 << 64, 5000, np.uint64)]
    sets.append(np.concatenate((sets[3], sets[2])))
    raw = np.array([nc._parity(x) for x in sets], object)
    assert len({len(x) for x in raw}) == 4 and len(nc._parity(np.arange(1 << 20, dtype=np.uint64))) == nc.PARITY_MOST // 8
    a, b = np.array([(i, j) for i in range(len(sets)) for j in range(len(sets))]).T
    found = nc.Bitmaps(raw).apart(a, b)
    for i, j, bits in zip(a, b, found):
        n = min(len(raw[i]), len(raw[j])) * 8
        odd = np.bincount(np.concatenate((sets[i], sets[j])) % np.uint64(n), minlength=n) & 1
        assert bits == odd.sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_sets():
    texts = [t for _, t in corpus()] + ["nul\x00inside is one word here"]
    found = nc.shingle_sets(pa.array(texts, pa.string()), 5)
    assert [len(x) for x in found] == [len(shingles(t)) for t in texts]
    assert not len(next(nc.shingle_sets(pa.array([""]), 5))) and next(nc.shingle_sets(pa.array(["b a"]), 5)).dtype == np.uint64
