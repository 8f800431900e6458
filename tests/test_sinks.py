from pathlib import Path

import pytest

from lattica.operators import sinks
from lattica.operators.contract import ContractError


def tables(spark, *ids):
    rows = [(i, "urn:x:projection:p", "c") for i in ids]
    return spark.createDataFrame(rows, "id string, projectionId string, commitSha string"), spark.createDataFrame([(f"e{i}", None) for i in ids], "id string, label string")


def current(spark, root):
    return [sorted(r["id"] for r in t.collect()) for t in sinks.published(spark, root)]


def test_both_tables_become_visible_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, root)
    first = sinks.publish(*tables(spark, "a", "b"), root, "urn:x:projection:p", "c1")
    assert current(spark, root) == [["a", "b"], ["ea", "eb"]]

    real, calls = sinks.digest, []

    def stops(rows):  # after the new nodes are written and read back, before the edges are
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(rows)

    monkeypatch.setattr(sinks, "digest", stops)
    with pytest.raises(RuntimeError):
        sinks.publish(*tables(spark, "x"), root, "urn:x:projection:p", "c2")
    monkeypatch.setattr(sinks, "digest", real)
    assert list(Path(root, "p", "c2").glob("generation-*/nodes")) and current(spark, root) == [["a", "b"], ["ea", "eb"]]
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, root, f"{root}/p/c2")
    second = sinks.publish(*tables(spark, "x"), root, "urn:x:projection:p", "c2")
    assert current(spark, root) == [["x"], ["ex"]] and [r["id"] for r in sinks.published(spark, root, first)[0].orderBy("id").collect()] == ["a", "b"]
    assert sinks.publish(*tables(spark, "x"), root, "urn:x:projection:p", "c2") == second
    with pytest.raises(sinks.Conflict):
        sinks.publish(*tables(spark, "y"), root, "urn:x:projection:p", "c2")
    assert current(spark, root) == [["x"], ["ex"]]


def test_a_second_publisher_finds_the_firsts_manifest(spark, tmp_path, monkeypatch):
    root, read = str(tmp_path), sinks._read
    at = sinks.publish(*tables(spark, "a"), root, "p", "c")
    monkeypatch.setattr(sinks, "_read", lambda s, path, seen=[]: None if path.endswith(sinks.MANIFEST) and not seen and not seen.append(1) else read(s, path))
    assert sinks.publish(*tables(spark, "a"), root, "p", "c") == at
    assert len(list(Path(at).glob("generation-*"))) == 1 and not list(Path(at).glob("manifest.json.*"))


def test_overwrite_reads_back_and_receipt_counts(spark, tmp_path):
    nodes, edges = tables(spark, "a", "b")
    at = str(tmp_path / "t")
    assert sinks.overwrite_with_readback(nodes, at) == 2 and spark.read.parquet(at).count() == 2
    with pytest.raises(ContractError, match="no rows"):
        sinks.overwrite_with_readback(nodes.limit(0), at)
    assert spark.read.parquet(at).count() == 2
    mixed = nodes.unionByName(spark.createDataFrame([("z", "urn:x:projection:q", "c")], nodes.schema))
    with pytest.raises(ContractError, match="projectionId"):
        sinks.overwrite_with_readback(mixed, str(tmp_path / "u"))
    assert tuple(sinks.receipt(nodes, edges).first()) == ("loaded", "urn:x:projection:p", "c", 2, 2)
