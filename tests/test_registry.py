import math
import subprocess
import sys

import duckdb
import pytest

from docloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(names)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    found = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    if name in registry.oracle_sql():
        got = db.execute(registry.oracle_sql()[name])
        assert plain(rows, found.columns) == plain(got.fetchall(), [c[0] for c in got.description])
    else:
        assert rows


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_rest_stands_alone():
    """Nothing outside imports the training-data subpackage."""
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        assert not name.startswith(('docloom.llm', 'corpus_pipeline')) or name == 'docloom.llm', name\nsys.meta_path.insert(0, No())\nimport docloom.plans.registry, docloom.api"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rpartition("/tests/")[0])
