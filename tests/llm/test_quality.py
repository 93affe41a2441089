import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import quality as q


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = q.run(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    held = found.where("held_out").join(labels, "doc_id").toPandas()
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.9
    assert held.score[held.quality == 1].mean() > held.score[held.quality == 0].mean() + 0.5
    assert ((found.toPandas().score >= 0.3).astype(int) == found.toPandas().predicted).all()


def test_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (6, None, 0), (None, 1, 1), (8, 0, 1), (13, 1, 0)], "doc_id long, quality int, toxic int")
    found = q.run(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    empty = {r.score for r in found if r.doc_id in (5, 6)}
    assert len(empty) == 1
    assert not any(r.held_out for r in found if r.doc_id is None)
    assert len({r.score for r in found if r.doc_id == 13}) == 1
    assert q.run(no_docs, labels).count() == 0
    assert {r.score for r in q.run(docs, labels.limit(0)).collect()} == {0.5}
    extra = q.score(docs, q.train([]))
    assert extra.schema["score"].dataType.simpleString() == "double" and extra.columns.count("score") == 1


def test_score_is_the_softmax_of_the_mean_vector():
    s = q.Settings(buckets=1 << 10)
    model = q.Model(np.random.default_rng(0).normal(size=s.buckets).astype(np.float32), 0.3, s)
    text = "some words some words again"
    packed = np.asarray(q._counts(pa.array([text]), s)[0].values).view(np.uint32)
    bucket, count = packed >> 16, packed & 0xFFFF
    logit = (model.table[bucket] * count).sum() / count.sum() + 0.3
    assert np.isclose(model.score_batch(pa.array([text]))[0], 1 / (1 + np.exp(-logit)))


def test_batches_do_not_mix_rows():
    s = q.Settings()
    model = q.Model(np.random.default_rng(1).normal(size=s.buckets).astype(np.float32), 0.0, s)
    texts = ["one two", "", None, "three four five", "x", "ü" * 9]
    together = model.score_batch(pa.array(texts, pa.string()))
    assert np.allclose(together, [model.score_batch(pa.array([t], pa.string()))[0] for t in texts])


def test_folds_follow_crc32(spark):
    import zlib

    ids = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", (q.fold_of("doc_id", 5) == 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids)
    assert ids and F is not None


def test_features_by_brute_force(spark, sf):
    """Each text's features are those of its words, pairs of words and runs of characters, looked at one by one."""
    s = q.Settings()

    def alone(text):
        ((_, _, buf, offs),) = q.tx.slices(pa.array([text]))
        return [b.tolist() for _, b in q.features(buf, offs, s)]

    texts = ["ein schöner Tag 日本語 テキスト", "a  a\tb\n😀😀😀", "x"]
    for t in texts:
        words = t.split()
        got = [b for _, b in q.features(*next(q.tx.slices(pa.array([t])))[2:], s)]
        want = [alone(w)[0][0] for w in words]
        if len(words) > 1:
            want += [alone(f"{a} {b}")[1][0] for a, b in zip(words, words[1:])]
        for i, k in enumerate(s.char_grams):
            # Runs without white space stand in the last lists of a text that is one run.
            runs = [t[j : j + k] for j in range(len(t) - k + 1)]
            want += [alone(r)[len(alone(r)) - 1 - (k == 3 and len(r) >= 5)][0] for r in runs]
        assert sorted(np.concatenate(got).tolist()) == sorted(want), t
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    model = q.Model(np.random.default_rng(3).normal(size=s.buckets).astype(np.float32), -0.2, s)
    for r in q.score(docs, model).collect():
        flat = np.concatenate([np.array(x) for x in alone(r.text)]) if r.text else np.zeros(0, int)
        z = (model.table[flat.astype(int)].astype(float).mean() if len(flat) else 0.0) - 0.2
        assert np.isclose(r.score, 1 / (1 + np.exp(-z)))


def test_large_counts_are_whole():
    s = q.Settings()
    (row,) = q._counts(pa.array(["a " * 150_000]), s)
    packed = np.asarray(row.values).view(np.uint32)
    ((_, _, buf, offs),) = q.tx.slices(pa.array(["a " * 150_000]))
    assert int((packed & 0xFFFF).sum()) == sum(len(b) for _, b in q.features(buf, offs, s)) > 4 * 0xFFFF
    model = q.train([(np.asarray(row.values), 1), (np.asarray(q._counts(pa.array(["other words"]), s)[0].values), 0)], s)
    scores = model.score_batch(pa.array(["a " * 150_000, "other words"]))
    assert scores[0] > 0.5 > scores[1]


def test_features_of_training_are_bounded(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 0), (8, 0, 1), (9, 0, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = q.fit(docs, labels), q.fit(docs, labels, s=q.Settings(max_train_features=0))
    assert a.table.any() and not b.table.any()
