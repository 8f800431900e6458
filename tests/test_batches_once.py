import json

from lattica.operators import contract, term_match
from lattica.sources import store_rows
from tests.test_term_match import NODE


def test_the_best_of_each_list_come_from_classes_of_equal_hits(spark, monkeypatch):
    words = ("pump", "pump ab", "valve", "ab")
    nodes = [(k, f"n{k:03}", "Concept" if k % 9 else "Tag", words[k % 4], "T", f"{k}.md", None, ["x"] * (k % 2), [words[k % 3]], "stable") for k in range(120)]
    df = spark.createDataFrame(nodes, NODE)
    asked = spark.createDataFrame([("q0", ["pump", "ab", "pump"]), ("q1", ["valve"]), ("q2", ["nothing"]), ("q3", ["ab", "x."])], "question_id string, terms array<string>")
    want = [sorted(map(repr, term_match.best_matches(term_match.resolve_batch(df, asked), n).collect())) for n in (1, 5)]
    scored = []
    monkeypatch.setattr(term_match, "_scored", lambda hits, *rest, f=term_match._scored: scored.append(hits.count()) or f(hits, *rest))
    assert [sorted(map(repr, term_match.best_batch(df, asked, n).collect())) for n in (1, 5)] == want
    assert max(scored) < 40  # rows of classes, not of concepts


def test_a_row_and_its_lists_are_parsed_once(spark):
    value = json.dumps({"id": "n", "kind": "Source", "title": "t", "tagsJson": '["a"]', "usageCountsJson": "[1]"})
    plan = store_rows.decode_nodes(spark.createDataFrame([(value,)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count("parsejson") <= 6


def test_kinds_of_few_nodes_are_judged_without_a_join_of_all_edges(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{k}", "Tag" if k in (3, 4) else "Source" if k == 5 else "Concept") for k in range(40)], "id string, kind string")
    rows = [(f"e{k}", ("LINKS_TO", "HAS_TAG", "OTHER", None)[k % 4], f"n{k % 41}", f"n{(k * 7) % 43}") for k in range(200)]
    edges = spark.createDataFrame(rows, "id string, type string, from string, to string")
    found = sorted(map(repr, contract.kind_mismatches(nodes, edges).collect()))
    monkeypatch.setattr(contract, "MOST_SENT", 0)
    assert found == sorted(map(repr, contract.kind_mismatches(nodes, edges).collect())) and len(found) > 100
    links = spark.createDataFrame([r for r in rows if r[1] == "LINKS_TO"], edges.schema)
    monkeypatch.undo()
    sizes = []
    monkeypatch.setattr(contract, "materialized", lambda df, f=contract.materialized: sizes.append((t := f(df)).count()) or t)
    contract.kind_mismatches(nodes, links).collect()
    assert sizes[0] < links.count()
