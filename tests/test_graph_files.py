import json

import pytest

from lattica.operators import contract, graph
from lattica.sources import graph_files

NODES = [{"id": "b", "kind": "Concept", "title": "B", "type": "T", "tags": ["x", "é"], "aliases": [], "path": "b.md", "usageCounts": None}, {"id": "a", "kind": "Source", "title": "A", "type": "Source", "usageCounts": [1, 2]}]
EDGES = [{"id": "e1", "from": "b", "to": "a", "type": "DERIVED_FROM"}, {"id": "e2", "from": "b", "to": "gone", "type": "LINKS_TO", "label": "l"}, {"id": "e3", "from": "gone", "to": "a", "type": "LINKS_TO"}]


@pytest.fixture
def snapshot(spark, tmp_path):
    whole = {"schemaVersion": "1.0", "okfVersion": "0.2", "source": {"repository": "r", "projectionId": "p", "commitSha": "c", "generatedAt": "g"}, "nodes": NODES, "edges": EDGES}
    (tmp_path / "s.json").write_text(json.dumps(whole, indent=2))
    return graph_files.read_snapshot(spark, str(tmp_path / "s.json"))


def test_a_snapshot_file_keeps_its_order_and_types(snapshot):
    nodes, edges, source = snapshot
    assert [(r["pos"], r["id"], r["tags"], r["usageCounts"]) for r in nodes.orderBy("pos").collect()] == [(0, "b", ["x", "é"], None), (1, "a", None, [1, 2])]
    assert [(r["pos"], r["from"], r["label"]) for r in edges.orderBy("pos").collect()] == [(0, "b", None), (1, "b", "l"), (2, "gone", None)]
    assert source.first()["repository"] == "r" and source.first()["okfVersion"] == "0.2"


def test_a_store_returns_no_dangling_edge(snapshot):
    nodes, edges, _ = snapshot
    assert [r["id"] for r in graph_files.stored_edges(nodes, edges).collect()] == ["e1"]
    assert graph_files.stored_edges(nodes.limit(0), edges).collect() == []


def test_expected_values_of_all_rows(spark):
    nodes = spark.createDataFrame([("n", "p", "c"), ("m", "q", "c")], "id string, projectionId string, commitSha string")
    edges = spark.createDataFrame([("e", "n", "m", "LINKS_TO", "p", None)], "id string, from string, to string, type string, projectionId string, commitSha string")
    wide = nodes.selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in {"kind": "string", "title": "string", "type": "string", "path": "string", "repositoryPath": "string", "conceptId": "string", "summary": "string", "resource": "string", "status": "string", "contentHash": "string", "normalizedValue": "string", "lastModified": "string", "tags": "array<string>", "aliases": "array<string>", "sourceIds": "array<string>", "authors": "array<string>", "usageCounts": "array<bigint>"}.items()])
    found = contract.violations(wide, edges.selectExpr("*", "cast(null as string) as label", "cast(null as string) as sourcePath"), expected={"projectionId": "p", "commitSha": "c"}).filter("rule like 'unexpected%'")
    assert sorted(map(tuple, found.collect()), key=repr) == [("unexpected_commitSha", None), ("unexpected_projectionId", "q")]


def test_lists_of_filters_are_bounded():
    for call in (lambda x: graph.of_types(x), lambda x: graph.with_tags(x), lambda x: graph.of_edge_types(x)):
        with pytest.raises(ValueError):
            call(["x"] * 21)
