import math

import duckdb
import numpy as np

from docloom.llm import mixing as mx


def test_sql(spark, sf):
    documents = duckdb.read_parquet(f"{sf}/documents.parquet")  # noqa: F841
    order = ["doc_id", "copy"]
    want = duckdb.sql(mx.SQL).df().sort_values(order).reset_index(drop=True)
    found = mx.run(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    assert found.shuffle_key.is_monotonic_increasing
    found = found.sort_values(order).reset_index(drop=True)
    assert found.equals(want[list(found.columns)])


def test_rates(spark):
    docs = spark.createDataFrame([(1, "a", "x" * 10), (2, "b", "x" * 40), (3, "c", "")], "doc_id long, source string, text string")
    found = {r[0]: r[1] for r in mx.rates(docs, s=mx.Settings(weights={"a": 3.0})).collect()}
    assert set(found) == {"a", "b"} and math.isclose(found["a"], 3 / 4 * 50 / 10) and math.isclose(found["b"], 1 / 4 * 50 / 40)


def test_distribution_function():
    for rate in (0.01, 0.7, 3.75, 40.0, 120.0):
        low, cdf = mx.distribution(rate)
        total = 0.0
        for k in range(low + min(len(cdf), 60)):
            total += math.exp(k * math.log(rate) - rate - sum(math.log(i) for i in range(1, k + 1)))
            if k >= low:
                assert math.isclose(cdf[k - low], total, rel_tol=1e-9)
        assert math.isclose(cdf[-1], 1.0, rel_tol=1e-9)


def test_large_rates():
    """Mean and variance of a million copies; the time and memory go with the root of the rate."""
    u = (np.arange(2000) + 0.5) / 2000
    for rate in (400.0, 50_000.0, 1e6, 3e9):
        got = mx.draw(u, np.full(2000, rate))
        assert abs(got.mean() - rate) < 0.01 * math.sqrt(rate) + 1 and abs(got.std() / math.sqrt(rate) - 1) < 0.01


def test_copies_beyond_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "big" if i else "tiny", "x" * (4000 if i else 1)) for i in range(5)], "doc_id long, source string, text string")
    want = mx.mix(docs).select("doc_id", "copies", "copy").collect()
    monkeypatch.setattr(mx, "_BLOCK", 7)
    assert mx.mix(docs).select("doc_id", "copies", "copy").collect() == want
    tiny = sorted(r.copy for r in want if r.doc_id == 0)
    assert tiny == list(range(1, want[[r.doc_id for r in want].index(0)].copies + 1)) and len(tiny) > 7000


def test_clashing_columns(spark):
    rows = [(1, "a", "some text", 0.5, [1.0], 9, "n"), (2, "b", "other text", 0.5, None, 9, None)]
    schema = "doc_id long, source string, text string, rate double, cdf array<double>, copy int, size string"
    for part in (rows, []):
        found = mx.mix(spark.createDataFrame(part, schema))
        assert found.columns == ["doc_id", "source", "text", "rate", "cdf", "size", "copies", "copy", "shuffle_key"]
        assert all(r.rate == 0.5 for r in found.collect())


def test_shares_meet_their_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id < 4500 then 'big' else 'small' end as source", "repeat('w', 50) as text")
    got = {r.source: r["count"] for r in mx.mix(docs, s=mx.Settings(weights={"big": 1.0, "small": 3.0})).groupBy("source").count().collect()}
    assert abs(got["small"] / 6000 - 0.75) < 0.03 and abs(got["big"] / 6000 - 0.25) < 0.03


def test_large_tables_of_rates_are_joined(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = mx.run(docs).toPandas(), mx.run(docs, mx.Settings(broadcast_sources=1)).toPandas()
    assert a.equals(b)


def test_awkward_rows(docs, no_docs):
    found = mx.mix(docs, s=mx.Settings(seed="s"))
    assert found.columns == [*[c for c in docs.columns if c != "copies"], "copies", "copy", "shuffle_key"]
    rows = found.collect()
    assert all(1 <= r.copy <= r.copies for r in rows)
    assert mx.mix(no_docs).count() == 0 and mx.run(docs).count() > 0
