import duckdb

import corpus_pipeline as cp
from docloom.llm import mixing, quality
from tests.llm.test_decontam import brute as hits
from tests.llm.test_linedup import brute as lines
from tests.llm.test_simhash_similar import brute as near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "mixing"]
    for number, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        kept = {r.doc_id: r for r in rows}
        if number < 4:
            assert after.columns == COLUMNS and len(rows) == len(kept)
        ids = sorted(before)
        if name == "quality":
            good = {r.doc_id for r in quality.run(docs, labels).where("predicted = 1").collect()}
            assert set(kept) == good and 0 < len(good) < len(before)
            assert all(kept[i] == before[i] for i in kept)
        elif name == "line_dedup":
            assert [kept[i].text for i in ids] == lines([before[i].text for i in ids])
            assert all(kept[i].n_chars == len(kept[i].text) for i in ids)
        elif name == "simhash":
            assert sorted(kept) == near([(i, before[i].text) for i in ids])
            assert all(kept[i] == before[i] for i in kept)
        elif name == "decontamination":
            clean = [i for i, h in zip(ids, hits([before[i].text for i in ids], bench)) if h[2] == 0]
            assert sorted(kept) == clean
        else:
            assert all(1 <= r.copy <= r.copies for r in rows) and [r.shuffle_key for r in stage(spark, docs, sf).collect()] == sorted(r.shuffle_key for r in rows)
            documents = duckdb.read_parquet(f"{tmp_path}/decontamination/*.parquet")  # noqa: F841
            want = duckdb.sql(mixing.SQL).fetchall()
            assert sorted((r.doc_id, r.copy) for r in rows) == sorted((w[0], w[3]) for w in want)
        docs = after
    # As a whole: what the stages, each held against brute force above, give one after the other.
    whole = lambda df: sorted(map(str, df.collect()))
    assert whole(cp.run(spark, sf)) == whole(docs)


def test_awkward_rows(spark, docs, no_docs, tmp_path, sf):
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            if name == "mixing":
                continue
            assert out.columns == table.columns
            # Columns that an operator also uses as a name of its own come through as they were.
            assert all((r.score, r.key, r.d, r.copies, r.component_id, r.tp) == ("x", 1, "y", None, "c", 5) for r in rows)
