from types import SimpleNamespace

import pytest

from docloom.operators import graph, query, store
from docloom.operators import index as ix


def test_a_cluster_must_name_its_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(session)
    with pytest.raises(ValueError, match="docloom.store"):
        store.Store.default(session)


def test_first_of_equal_edges_stays(spark):
    ddl = "source_base string, from_entity_id string, to_entity_id string, edge_type string, source_kind string, param_name string, confidence double, snippet string, page_url string, line_start int, line_end int, n int"
    edges = spark.createDataFrame([("s", "a", "b", "returns", "xref", "", c, t, "p", None, None, n) for c, t, n in ((0.5, "second", 2), (0.2, "first", 1), (0.9, "third", 3))], ddl)
    (row,) = graph.unique_edges(edges, ["n"]).collect()
    assert (row.confidence, row.snippet) == (0.2, "first") and "n" not in row.asDict()
    (row,) = graph.unique_edges(edges.drop("n")).collect()
    assert row.snippet == "third"


def test_links_of_equal_keys_keep_the_first(spark):
    ddl = "source_base string, page_url string, entity_id string, line_start int, line_end int, xrefs array<struct<edge_type string, source_kind string, target_url string, target_anchor string, target_name string, snippet string, confidence double>>"
    links = [("see_also", "", "u", "a", "n", "t", 0.0), ("see_also", "xref", "u", "a", "n", "t", 0.4), ("see_also", "xref", "u", "b", "n", "t", 0.4)]
    found = graph.link_candidates(spark.createDataFrame([("s", "p", "e", None, None, links)], ddl)).collect()
    assert sorted((r.target_anchor, r.confidence) for r in found) == [("a", 1.0), ("b", 0.4)]


def test_plans_of_many_queries(spark):
    asked = ["send_photo InputFile photo", "", None, 'foo "bar baz" qux', "the a of"]
    found = query.plans(spark.createDataFrame([(t,) for t in asked], "asked string"), "asked").collect()
    assert [r.plan for r in found] == [[s.match() for s in query.stages(t or "")] for t in asked]


def test_kept_totals_are_those_of_the_lengths(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "three three two")], "k long, t string")
    index = ix.build(rows, ["k"], ["t"], "simple")
    kept = ix.Index(index.postings, index.lengths, index.keys, index.columns, index.analyzer, ix.totals(index.lengths))
    plan = ix.Plan.of([query.Stage((), ("two",))], "simple")
    ranks = lambda i: sorted((r.k, r["rank"]) for r in ix.match(ix.look_up(i, plan), plan).collect())
    assert ranks(kept) == ranks(index) and len(ranks(kept)) == 3


def test_postings_are_made_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "b a b", "a"), (2, "", None), (3, None, "b")], "k long, t string, u string")
    postings = ix.build(rows, ["k"], ["t", "u"], "simple").postings
    found = sorted((r.term, r.k, r.length, r.positions) for r in postings.collect())
    assert found == [("a", 1, 4, [1, ix.COLUMN_STEP]), ("b", 1, 4, [0, 2]), ("b", 3, 1, [ix.COLUMN_STEP])]
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
