import json

import brute_rules
import pytest
from pyspark.sql import functions as F

from lattica.operators import bm25, evaluate, project, sinks, validate
from lattica.operators.contract import violations
from lattica.schema import FLAT_EDGE
from lattica.sources import bundle, graph_files

FILES = {
    "index.md": "---\nokf_version: '0.2'\n---\n# Home\n\n- [One](a/one.md)\n",
    "log.md": "# Log\n\n## 2024-01-02\n\n## 2024-02-30\n",
    "a/one.md": "---\ntype: Machine\ntitle: One\ntags: [Hot, hot , Cold]\naliases: [uno]\nuid: u1\nstatus: draft\nsources:\n  - resource: http://s\n    title: S\n    usage_count: 3\n---\nSee [two](two.md#x) and [two again](two).\n\n```\n[no](no.md)\n```\n![pic](p.png) [ext](https://x.y) [gone](gone.md) [up](../../up.md) [ref][R]\n\n[r]: /a/two.md\n",
    "a/two.md": "﻿---\r\ntype: Part\r\nuid: u1\r\nstale_after: 2024-01-01T00:00:00Z\r\nactive: yes\r\n---\r\nBack to [one](./one.md)\r\n",
    "a/three_four-five.md": "no header\n",
    "a/bad.md": "---\ntype: X\ntype: Y\n---\nbody\n",
    "a/open.md": "---\ntype: X\n",
    ".git/x.md": "# hidden\n",
    "node_modules/p/x.md": "# hidden\n",
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "a/latin.md").write_bytes(b"---\ntype: \xe9\n---\n")
    parsed, reading = bundle.read_bundle(spark, str(root))
    return parsed.cache(), reading.cache()


def test_reading_and_parsing(docs):
    parsed, reading = docs
    rows = {r["path"]: r for r in parsed.withColumn("json", F.to_json("frontmatter")).drop("frontmatter").collect()}
    assert set(rows) == {"index.md", "log.md", "a/one.md", "a/two.md", "a/three_four-five.md", "a/bad.md", "a/open.md"}
    assert [(r["code"], r["path"]) for r in reading.collect()] == [("INVALID_UTF8", "a/latin.md")]
    two = rows["a/two.md"]
    assert json.loads(two["json"]) == {"type": "Part", "uid": "u1", "stale_after": "2024-01-01T00:00:00Z", "active": "yes"}
    assert (two["kind"], two["conceptId"], two["bodyLineOffset"], two["body"]) == ("concept", "a/two", 6, "Back to [one](./one.md)\n")
    assert [(x["label"], x["target"], x["line"], x["column"]) for x in rows["a/one.md"]["links"]] == [("two", "two.md#x", 1, 5), ("two again", "two", 1, 25), ("ext", "https://x.y", 6, 15), ("gone", "gone.md", 6, 34), ("up", "../../up.md", 6, 50), ("ref", "/a/two.md", 6, 68)]
    assert rows["a/bad.md"]["problems"][0]["line"] == 3 and len(rows["a/open.md"]["problems"]) == 1


def test_links_and_diagnostics(docs):
    parsed, reading = docs
    fates = {(r["path"], r["target"]): (r["result"], r["target_path"]) for r in project.resolve_links(parsed).collect()}
    assert fates[("a/one.md", "two.md#x")] == fates[("a/one.md", "two")] == fates[("a/one.md", "/a/two.md")] == ("concept", "a/two.md")
    assert [fates[("a/one.md", t)][0] for t in ("https://x.y", "gone.md", "../../up.md")] == ["external", "broken", "outside"]
    found = sorted((r["code"], r["path"], r["line"]) for r in validate.validate(parsed, reading).collect() if r["line"] is None or r["code"].endswith("LINK") or "OUTSIDE" in r["code"])
    assert ("BROKEN_LINK", "a/one.md", 18) in found and ("LINK_OUTSIDE_BUNDLE", "a/one.md", 18) in found
    codes = {(r[0], r[1]) for r in found}
    assert {("MISSING_FRONTMATTER", "a/three_four-five.md"), ("INVALID_LOG_DATE", "log.md"), ("INVALID_UTF8", "a/latin.md"), ("DUPLICATE_CONCEPT_UID", "a/one.md"), ("DUPLICATE_CONCEPT_UID", "a/two.md"), ("BROKEN_LINK", "a/one.md"), ("LINK_OUTSIDE_BUNDLE", "a/one.md")} <= codes
    total = validate.summary(validate.validate(parsed, reading)).first()
    assert not total["valid"] and total["errors"] == 5


def codes(spark, header, body="", kind="concept", path="x.md", has=True):
    """Codes of the expressions, which are those of the rules said one document at a time."""
    row = spark.createDataFrame([(path, kind, json.dumps(header), has, body)], "path string, kind string, header string, hasFrontmatter boolean, body string")
    got = validate.per_document(row.withColumn("frontmatter", F.parse_json("header")).withColumn("problems", F.lit(None).cast("array<struct<code:string,message:string,line:int,column:int>>")))
    found = sorted(r["code"] for r in got.collect())
    assert found == sorted(c for c, _ in brute_rules.document_rules(path, kind, header, has, body))
    return found


@pytest.mark.parametrize(
    "header,expected",
    [
        ({}, ["TYPE_REQUIRED"]),
        ({"type": "T", "title": "", "tags": ["a", 1]}, ["INVALID_RECOMMENDED_FIELD", "INVALID_TAGS"]),
        ({"type": "T", "sources": {}}, ["INVALID_SOURCES"]),
        ({"type": "T", "sources": [1, {"id": "", "title": 2, "usage_count": 1.5, "usage_window": 1}]}, ["INVALID_SOURCE", "INVALID_SOURCE_FIELD", "INVALID_SOURCE_ID", "INVALID_USAGE_COUNT", "INVALID_USAGE_WINDOW", "SOURCE_RESOURCE_REQUIRED"]),
        ({"type": "T", "sources": [{"resource": "r", "id": "a"}, {"resource": "r", "id": "a", "last_modified": "2024-02-30T00:00Z"}]}, ["DUPLICATE_SOURCE_ID", "INVALID_TIMESTAMP"]),
        ({"type": "T", "generated": {"by": "me"}, "verified": [], "status": "old"}, ["INVALID_ACTOR", "INVALID_STATUS", "INVALID_VERIFIED"]),
        ({"type": "T", "generated": 1, "verified": [1, {"by": "human:x", "at": "2024-02-29T10:00+01:00"}]}, ["INVALID_GENERATED", "INVALID_VERIFICATION_EVENT"]),
        ({"type": "Attested Computation", "parameters": 1, "executor": {}}, ["ATTESTED_RUNTIME_REQUIRED", "COMPUTATION_REQUIRED", "INVALID_COMPUTATION_FIELD", "INVALID_PARAMETERS"]),
    ],
)
def test_concept_rules(spark, header, expected):
    assert codes(spark, header) == expected


def test_other_rules(spark):
    fence = "# Computation\n```\nx\n```\n"
    assert codes(spark, {"type": "Attested Computation", "runtime": "r", "computation": "p"}, fence) == ["AMBIGUOUS_COMPUTATION"]
    assert codes(spark, {"type": "Attested Computation", "runtime": "r", "parameters": [{}]}, fence + "```\ny\n```") == ["INVALID_PARAMETER", "MULTIPLE_COMPUTATIONS"]
    assert codes(spark, {"okf_version": "9"}, "# A\n- [x](y)", "index", "index.md") == ["UNSUPPORTED_OKF_VERSION"]
    assert codes(spark, {"okf_version": 1, "z": 2}, "", "index", "index.md") == ["INDEX_HAS_NO_ENTRIES", "INDEX_SECTION_REQUIRED", "INVALID_INDEX_FRONTMATTER", "INVALID_OKF_VERSION"]
    assert codes(spark, {}, "# A\n* [x](y)", "index", "a/index.md") == ["INDEX_FRONTMATTER_NOT_ALLOWED"]
    assert codes(spark, {}, "", "log", has=True) == ["LOG_DATE_REQUIRED", "LOG_FRONTMATTER_NOT_ALLOWED", "LOG_TITLE_REQUIRED"]
    assert codes(spark, {}, "# L\n## 2024-01-01\n## 2024-01-02", "log", has=False) == ["LOG_NOT_NEWEST_FIRST"]


def test_projection_and_flat_rows(docs, spark, tmp_path):
    parsed, _ = docs
    good = parsed.filter("size(problems) = 0 and hasFrontmatter or kind <> 'concept'")
    out = project.project(good, project.Options("git@host:me/repo.git", "a" * 40, "2024-01-01T00:00:00Z"))
    nodes = out.nodes.collect()
    assert [(n["kind"], n["title"]) for n in nodes if n["kind"] != "Concept"] == [("Tag", "Cold"), ("Tag", "Hot"), ("Source", "S"), ("Term", "uno")] or {(n["kind"], n["title"]) for n in nodes} >= {("Tag", "Cold"), ("Tag", "Hot"), ("Source", "S"), ("Term", "uno")}
    one = next(n for n in nodes if n["conceptId"] == "a/one")
    assert one["tags"] == ["Cold", "Hot"] and one["status"] == "draft" and one["sourceUrl"] == f"https://host/me/repo/blob/{'a' * 40}/a/one.md"
    edges = out.edges.collect()
    assert all(e["sourcePath"] for e in edges) and all(e["label"] for e in edges if e["type"] != "LINKS_TO")
    assert sorted((e["type"], e["label"]) for e in edges if e["type"] == "LINKS_TO") == [("LINKS_TO", "one"), ("LINKS_TO", "ref")]
    assert {e["type"] for e in edges} == {"LINKS_TO", "HAS_TAG", "ALIASED_AS", "DERIVED_FROM"}
    assert sorted(n["pos"] for n in nodes) == list(range(len(nodes))) and out.manifest.first()["concepts"] == 2
    assert violations(out.nodes, out.edges).collect() == []
    source = spark.createDataFrame([("r", "2024-01-01T00:00:00Z", "0.2")], "repository string, generatedAt string, okfVersion string")
    flat, flat_edges = project.flat_nodes(out.nodes, source), project.flat_edges(out.edges)
    sinks.write_ndjson(flat, str(tmp_path / "nodes"))
    sinks.write_ndjson(flat_edges, str(tmp_path / "edges"))
    read_nodes, read_edges = graph_files.read_flat_graph(spark, str(tmp_path / "nodes"), str(tmp_path / "edges"))
    again, again_edges = graph_files.decode_flat(read_nodes, read_edges)
    columns = ["id", "kind", "title", "tags", "path", "status", "usageCounts"]
    assert sorted(map(str, again.select(columns).collect())) == sorted(map(str, out.nodes.select(*[F.col(c) if c != "usageCounts" else F.col(c) for c in columns]).collect()))
    assert again_edges.count() == len(edges)
    (tmp_path / "bad.json").write_text('{"id": ["x"]}\n')
    with pytest.raises(graph_files.SchemaMismatch):
        graph_files.read_exact_ndjson(spark, str(tmp_path / "bad.json"), FLAT_EDGE)
    at = sinks.publish(out.nodes.drop("pos"), out.edges.drop("pos"), str(tmp_path / "pub"), out.manifest.first()["projectionId"], "a" * 40)
    assert sinks.publish(out.nodes.drop("pos"), out.edges.drop("pos"), str(tmp_path / "pub"), out.manifest.first()["projectionId"], "a" * 40) == at
    with pytest.raises(sinks.Conflict):
        sinks.publish(out.nodes.drop("pos").limit(1), out.edges.drop("pos"), str(tmp_path / "pub"), out.manifest.first()["projectionId"], "a" * 40)


def test_chunks():
    assert bm25.chunk_texts("# A\n\nx\n# B\ny", 300, 10) == ["# A\n\nx\n\n# B\ny"]
    first = "w " * 400
    assert bm25.chunk_texts(first, 300, 10) == [first.strip()]
    two = bm25.chunk_texts("a" * 290 + "\n\n" + "b" * 290 + " end", 300, 20)
    assert [len(x) for x in two] == [290, 300, 34] or all(len(x) <= 300 for x in two)
    assert bm25.chunk_texts("", 300, 10) == []


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("1", "u1", "a", 0, "t", "T", "stable", "red pump red"), ("2", "u2", "b", 0, "t", "T", "stable", "blue pump"), ("3", "u3", "c", 0, "t", "T", "draft", "red red red")], "id string, uid string, path string, ordinal int, title string, type string, status string, text string")
    asked = spark.createDataFrame([("q", "Red"), ("none", "zz")], "query_id string, query string")
    import math

    tf, n, avg = 2, 3, 2.5
    want = math.log(1 + (2 - 1 + 0.5) / 1.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    got = bm25.top_chunks(bm25.search(chunks, asked), chunks, 5).collect()
    assert [(r["query_id"], r["id"], round(r["score"], 6), r["matched_tokens"]) for r in got] == [("q", "1", round(want, 6), ["red"])]


def test_evaluation(spark):
    cases = spark.sql("select 'q' as id, array('a','b','a') as retrieved, array('a','c') as required, array('b') as excluded, map('a','stable') as required_statuses, map('a','stable') as actual_statuses, array(array('f','a'), array('f','c')) as required_paths, array(array('f','a')) as supported_paths, true as focus_matched, false as truncated")
    r = evaluate.acceptance(evaluate.metrics(cases)).first()
    assert (r["recall"], r["precision"], r["f1"], r["path_recall"], r["excluded_hits"], r["status_passed"], r["accepted"]) == (0.5, 0.5, 0.5, 0.5, ["b"], True, False)
    assert evaluate.metrics(cases.withColumn("supported_paths", F.lit(None).cast("array<array<string>>"))).first()["path_recall"] is None
    rules = (("Acceptance Test", (r"^(?:fat|sat)$", r"\bacceptance tests?\b")), ("Change Request", (r"\bchange requests?\b",)))
    assert evaluate.requested_types("Which FAT and change request apply?", ["FAT", "Change Request"], rules) == ["Acceptance Test", "Change Request"]
    with pytest.raises(ValueError):
        evaluate.requested_types("Which FAT?", ["SAT"], rules)
    with pytest.raises(ValueError):
        evaluate.requested_types("Which pump?", ["pump"], rules)
