import random

import pytest

from lattica.operators import graph, paths
from lattica.plans import driver_graph as G

SF = "/root/testdata/sf0.001"


def test_nodes_and_edges_are_views_and_few_rows_are_walked_from_without_a_shuffle(spark, monkeypatch):
    def written(*_):
        raise AssertionError("a view writes nothing")

    monkeypatch.setattr("lattica.sources.shared.materialized", written)
    monkeypatch.setattr("lattica.plans.driver_graph.materialized", written, raising=False)
    nodes, edges, links = G.nodes(spark, SF), G.edges(spark, SF), G.links(spark, SF)
    assert nodes.count() and edges.count() == links.distinct().count()
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    steps = graph.moves(spark.createDataFrame([("r", "nation:3")], "root string, at string"), links, "both")
    assert steps.count() and "SortMergeJoin" not in plan(steps) and "Exchange hash" not in plan(steps)


@pytest.mark.parametrize("direction", ["outgoing", "both"])
def test_hops_are_those_of_the_paths(spark, direction):
    rng = random.Random(5)
    nodes = spark.createDataFrame([(f"n{k}", "Concept" if k % 8 else "Tag") for k in range(30)], "id string, kind string")
    rows = [(k, f"e{k}", f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", "LINKS_TO") for k in range(45)]
    edges = spark.createDataFrame(rows + rows[:9], "pos int, id string, from string, to string, type string")
    pairs = spark.createDataFrame([("n1", f"n{k}") for k in range(30)] + [("n1", None), ("lost", "n2"), ("n1", "n4")], "root string, target string")
    hops = paths.find_hops(pairs, nodes, edges, 4, direction)
    ways = paths.find_paths(pairs, nodes, edges, 4, direction).select("root", "target", "hop_count")
    assert sorted(map(repr, hops.collect())) == sorted(map(repr, ways.collect()))
