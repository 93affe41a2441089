import random

from docloom.llm.components import stars


def test_random_graphs(spark):
    rng = random.Random(2)
    for size, m in ((40, 30), (60, 80), (30, 0)):
        edges = [(rng.randrange(size), rng.randrange(size)) for _ in range(m)] + [(None, 1), (2, None), (3, 3)]
        edges += [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
        root = {}

        def find(x, root=root):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a is not None and b is not None:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        want = {(v, find(v)) for v in root if find(v) != v}
        assert {tuple(r) for r in stars(spark.createDataFrame(edges, "v long, p long")).collect()} == want


def test_no_edges(spark):
    assert stars(spark.createDataFrame([], "v long, p long")).count() == 0
