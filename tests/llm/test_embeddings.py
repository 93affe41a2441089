import numpy as np
import pytest

from docloom.llm import embeddings as em


def brute(ids, vectors, least=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    n = len(ids)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], float), np.array(vectors[j], float)
                near[i, j] = (x @ y) / np.sqrt((x @ x) * (y @ y)) >= least
    label = list(ids)
    for _ in range(n):
        for i in range(n):
            label[i] = min([label[i], *(label[j] for j in np.flatnonzero(near[i]))])
    return [(i, int(near[k].sum()), label[k], label[k] == i) for k, i in enumerate(ids)]


def cloud(seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(8):
        x = rng.normal(size=6)
        for _ in range(9):
            x = x + rng.normal(size=6) * 0.12
            out.append([float(v) for v in x.astype(np.float32)])
    return out + [out[0], out[0], out[5]] + [[float(v) for v in rng.normal(size=6).astype(np.float32)] for _ in range(20)]


@pytest.mark.parametrize("cell,pivots", [(4096, 1024), (8, 1024), (5, 3)])
def test_against_brute_force(spark, cell, pivots):
    vectors = [*cloud(), None, [], [0.0] * 6, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(10, 10 + len(vectors)))
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, label int, vec string")
    found = sorted(tuple(r) for r in em.run(table, s=em.Settings(cell=cell, max_pivots=pivots)).collect())
    assert found == brute(ids, vectors)


def test_test_data(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted(table.select("vec_id", "embedding").collect())
    X = np.array([r.embedding for r in rows], float)
    U = X / np.linalg.norm(X, axis=1)[:, None]
    assert [r.n_links for r in sorted(em.run(table).collect())] == ((U @ U.T >= 0.95).sum(1) - 1).tolist()


def test_empty_and_unusable(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert em.run(table).count() == 0
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in em.run(none).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_null_ids_count_as_links(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.01]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in em.run(table).collect()}
    assert found == {None: (1, 5), 5: (1, 5), 7: (0, 7)}
