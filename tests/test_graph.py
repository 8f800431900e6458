import gc
import random
from collections import deque
from pathlib import Path

import pytest

from lattica.operators import contract, graph, paths
from lattica.operators.adjacency import adjacency, steps_from
from lattica.plans.snapshot import Snapshot, SnapshotManager

NODE = "pos int, id string, kind string, title string, type string, path string, summary string, tags array<string>, aliases array<string>, status string"
EDGE = "pos int, id string, from string, to string, type string, label string"


def tables(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


@pytest.fixture(scope="module")
def small(spark):
    nodes = [
        (0, "c1", "Concept", "Red Pump", "Machine", "m/red-pump.md", None, ["Hot", "ÉTÉ"], ["rp-1"], "stable"),
        (1, "c2", "Concept", "Blue pump", "Machine", "m/blue.md", "cools the red pump", [], ["bp"], "draft"),
        (2, "c3", "Concept", "Valve", "Part", "p/valve.md", None, ["hot"], [], "stable"),
        (3, "t1", "Tag", "Hot", "Tag", None, None, [], [], None),
    ]
    edges = [(0, "e0", "c1", "c2", "LINKS_TO", "x"), (1, "e1", "c2", "c3", "LINKS_TO", None), (2, "e2", "c1", "t1", "HAS_TAG", None), (3, "e3", "c2", "c3", "LINKS_TO", "again")]
    return tables(spark, nodes, edges)


def ids(rows):
    return [r["id"] for r in rows.collect()]


def test_filters_and_order(small):
    nodes, _ = small
    assert ids(graph.browse(nodes)) == ["c2", "c1", "c3"]
    assert ids(graph.browse(nodes, "m")) == ["c2", "c1"]
    assert ids(graph.browse(nodes, types=[])) == [] and ids(graph.browse(nodes, tags=[])) == ["c2", "c1", "c3"]
    assert ids(graph.browse(nodes, types=[" machine "], tags=["HOT", "été"])) == ["c1"]
    assert ids(graph.browse(nodes, offset=5)) == []
    assert tuple(graph.page_info(graph.browse_rows(nodes), 2, 0).first()) == (3, 2, 0, True, 2)
    assert tuple(graph.page_info(graph.browse_rows(nodes), 2, 9).first()) == (3, 0, 9, False, None)
    with pytest.raises(ValueError):
        graph.browse(nodes, limit=101)


def test_resolve_ladder(small):
    nodes, _ = small
    got = {r["id"]: (r["score"], r["n_matched"], r["matched_fields"]) for r in graph.resolve(nodes, ["red pump", "machine", "hot"]).collect()}
    assert got == {"c1": (250, 3, ["tags", "title", "type"]), "c2": (80, 2, ["summary", "type"]), "c3": (80, 1, ["tags"])}
    assert ids(graph.resolve(nodes, ["valve", "valve"])) == ["c3"]
    with pytest.raises(ValueError):
        graph.resolve(nodes, ["x"])


def test_backlinks_are_per_edge_and_neighbours_skip_other_kinds(small, spark):
    nodes, edges = small
    assert [r["edge_id"] for r in graph.backlinks("c3", nodes, edges).collect()] == ["e1", "e3"]
    kept, incident, flags = graph.neighbors(spark.createDataFrame([("c1",)], "root string"), nodes, edges, 2)
    assert sorted((r["id"], r["distance"]) for r in kept.collect()) == [("c1", 0), ("c2", 1), ("c3", 2)]
    assert sorted(r["edge_id"] for r in incident.collect()) == ["e0", "e1", "e3"]
    assert not flags.first()["truncated"]
    with pytest.raises(graph.NotFound):
        graph.require(nodes, ["t1"])


def queue_walk(nodes, edges, root, hops, direction, limit):
    kept, order, cut = {root: 0}, deque([root]), False
    via = {}
    while order:
        at = order.popleft()
        if kept[at] >= hops:
            continue
        moves = [(e[0], e[3], e[1]) for e in edges if e[2] == at] if direction != "incoming" else []
        if direction != "outgoing":
            moves += [(e[0], e[2], e[1]) for e in edges if e[3] == at]
        for _, to, edge in moves:
            if to in kept:
                continue
            if limit is not None and len(kept) > limit:
                cut = True
                continue
            kept[to], via[to] = kept[at] + 1, (at, edge)
            order.append(to)
    return kept, cut, via


@pytest.mark.parametrize("seed", range(4))
def test_walk_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    n = 12
    nodes = [(k, f"n{k}", "Concept", "t", "T", f"{k}.md", None, [], [], "stable") for k in range(n)]
    edges = [(k, f"e{k}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", "LINKS_TO", None) for k in range(20)]
    n_df, e_df = tables(spark, nodes, edges)
    roots = [f"n{k}" for k in range(3)]
    frame = spark.createDataFrame([(r,) for r in roots], "root string")
    direction = ("outgoing", "incoming", "both", "both")[seed]
    limit = (None, 3, 4, 2)[seed]
    rows = graph.walk(frame, n_df, e_df, 2, direction, limit=limit).collect()
    for r in roots:
        kept, cut, _ = queue_walk(nodes, edges, r, 2, direction, limit)
        assert {x["id"]: x["distance"] for x in rows if x["root"] == r and x["kept"]} == kept
        assert any(x["root"] == r and not x["kept"] for x in rows) == cut
    pairs = spark.createDataFrame([(r, f"n{k}") for r in roots for k in range(n)], "root string, target string")
    links = adjacency(n_df, e_df, block=3)
    assert sorted(map(tuple, graph.walk(frame, n_df, links, 2, direction, limit=limit).collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, graph.expand_typed(frame, n_df, links, 2, cap=2).collect())) == sorted(map(tuple, graph.expand_typed(frame, n_df, e_df, 2, cap=2).collect()))
    found = paths.find_paths(pairs, n_df, links, 3, direction).collect()
    assert sorted(map(tuple, paths.find_paths(pairs, n_df, e_df, 3, direction).collect()), key=repr) == sorted(map(tuple, found), key=repr)
    for x in found:
        kept, _, via = queue_walk(nodes, edges, x["root"], 3, direction, None)
        if x["target"] not in kept:
            assert x["hop_count"] is None and x["node_ids"] is None
            continue
        path, steps = [x["target"]], []
        while path[0] != x["root"]:
            at, edge = via[path[0]]
            path.insert(0, at)
            steps.insert(0, edge)
        assert (x["hop_count"], x["node_ids"], x["edge_ids"]) == (kept[x["target"]], path, steps)


def test_paths_of_six_hops_meet_halfway_and_keep_the_queues_choice(spark):
    rng = random.Random(11)
    n = 60
    nodes = [(k, f"n{k}", "Concept" if k % 9 else "Tag", "t", "T", f"{k}.md", None, [], [], "stable") for k in range(n)]
    edges = [(k, f"e{k}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", "LINKS_TO", None) for k in range(90)]
    n_df, e_df = tables(spark, nodes, edges)
    concept = {x[1] for x in nodes if x[2] == "Concept"}
    some = [e for e in edges if e[3] in concept]
    ends = [(f"n{a}", f"n{b}") for a in (0, 1, 2) for b in range(0, n, 2)] + [("n1", None), ("lost", "n2"), ("n1", "n4")]
    rows = paths.find_paths(spark.createDataFrame(ends, "root string, target string"), n_df, adjacency(n_df, e_df), 6).collect()
    assert len(rows) == len(set(ends)) and max(x["hop_count"] or 0 for x in rows) >= 5
    for x in rows:
        kept, _, via = queue_walk(nodes, some, x["root"], 6, "outgoing", None)
        if x["target"] not in kept:
            assert (x["hop_count"], x["node_ids"], x["edge_ids"]) == (None, None, None)
            continue
        path, steps = [x["target"]], []
        while path[0] != x["root"]:
            at, edge = via[path[0]]
            path.insert(0, at)
            steps.insert(0, edge)
        assert (x["hop_count"], x["node_ids"], x["edge_ids"]) == (kept[x["target"]], path, steps)


def test_a_hubs_steps_are_spread_over_tasks_and_a_cap_reads_its_first_blocks(spark):
    from pyspark.sql import functions as F

    n = 6000
    nodes = spark.range(n).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("n"), F.col("id")).alias("id"), F.lit("Concept").alias("kind"))
    edges = spark.range(1, n).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("e"), F.col("id")).alias("id"), F.lit("n0").alias("from"), F.concat(F.lit("n"), F.col("id")).alias("to"), F.lit("LINKS_TO").alias("type"))
    links = adjacency(nodes, edges, block=64)
    hub = spark.createDataFrame([("n0",)], "at string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        reached = steps_from(hub, links, "both")
        by_task = sorted(r["count"] for r in reached.groupBy(F.spark_partition_id()).count().collect())
        assert sum(by_task) == n - 1 and len(by_task) == 4 and by_task[-1] <= 2 * by_task[len(by_task) // 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = steps_from(hub, links, "outgoing", 100)
    assert sorted(r["edge_pos"] for r in first.collect()) == list(range(1, 101))
    assert steps_from(hub, links, "incoming").count() == 0


def test_budget(spark):
    rows = spark.createDataFrame([(0, "a" * 700), (1, "b" * 900), (2, "c" * 50), (3, "d")], "pos int, text string")
    got = [(len(r["content"]), r["truncated"]) for r in graph.budgeted(rows, per_document=800, budget=1530).orderBy("pos").collect()]
    assert got == [(700, False), (800, True), (30, True), (0, True)]
    astral = spark.createDataFrame([(0, "😀" * 3), (1, "a😀b"), (2, "é")], "pos int, text string")
    cut = lambda budget: [(r["content"], r["truncated"], r["total_characters"]) for r in graph.budgeted(astral, per_document=5, budget=budget).orderBy("pos").collect()]
    assert cut(100) == [("😀😀", True, 6), ("a😀b", False, 4), ("é", False, 1)]
    assert cut(7) == [("😀😀", True, 6), ("a", True, 4), ("", True, 1)]


def test_contract(small):
    nodes, edges = small
    from pyspark.sql import functions as F

    assert {tuple(r) for r in contract.dangling(nodes.filter("id <> 'c3'"), edges).collect()} == {("e1", "c3"), ("e3", "c3")}
    bad = edges.withColumn("type", F.when(F.col("id") == "e2", "LINKS_TO").otherwise(F.col("type")))
    assert [tuple(r) for r in contract.kind_mismatches(nodes, bad).collect()] == [("e2", "LINKS_TO", "Concept", "Tag")]
    with pytest.raises(contract.ContractError):
        contract.within_limit(nodes, 4, "nodes")
    with pytest.raises(contract.ContractError):
        contract.single_value(nodes, "kind")


def test_snapshot_manager_renews_after_its_time(small):
    nodes, edges = small
    now, loads = [0.0], []

    def load():
        loads.append(1)
        return Snapshot(nodes, edges)

    manager = SnapshotManager(load, ttl=60, validate=False, clock=lambda: now[0])
    first = manager.acquire()
    assert manager.acquire() is first
    now[0] = 61
    assert manager.acquire() is not first and len(loads) == 2
    assert [r["id"] for r in manager.acquire().browse_index("p").collect()] == ["c3"]
    with pytest.raises(ValueError):
        SnapshotManager(load, ttl=0)


def test_a_generation_outlives_its_source_and_goes_with_its_last_reader(spark, tmp_path):
    def write(title):
        spark.createDataFrame([(0, "c1", "Concept", title, "T", "c1.md", None, [], [], "stable")], NODE).write.mode("overwrite").parquet(str(tmp_path / "nodes"))

    def load():
        return Snapshot(spark.read.schema(NODE).parquet(str(tmp_path / "nodes")), spark.createDataFrame([], EDGE))

    now = [0.0]
    write("first")
    manager = SnapshotManager(load, ttl=60, validate=False, clock=lambda: now[0])
    held = manager.acquire()
    folder = Path(held.nodes.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    write("second")
    now[0] = 61
    with manager.reading() as new:
        assert [r["title"] for r in new.browse_index().collect()] == ["second"]
    assert [r["title"] for r in held.browse_index().collect()] == ["first"] and folder.exists()
    del held
    gc.collect()
    assert not folder.exists()
