"""Shortest paths of many pairs at once, by search from both ends.

Two frontiers grow, the one with fewer steps to take first: from the roots along the
edges and from the targets against them. A pair is done when a node is in both;
a root or target without an open pair is not walked from any more, and the
search ends when no pair is open or the hops are used up.

Each frontier row carries its best way as a list of steps, compared step by step
by (direction, edge): of equally short paths that is the order in which a queue
would find them. So no ranks, windows or look-backs are needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.adjacency import Adjacency
from lattica.operators.graph import check, moves, of_ids, only_concepts, served
from lattica.sources.shared import dematerialized, materialized

STEPS = "array<struct<dir:int,edge_pos:{pos},id:string,via:string>>"
_AGAINST = {"outgoing": "incoming", "incoming": "outgoing", "both": "both"}


def _grown(frontier: DataFrame, seen: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, direction: str, edge_types: Sequence[str] | None, back: bool) -> DataFrame:
    """The next level (end, id, and way if the frontier has it) in a written table: its nodes' first discoveries, each with its smallest way."""
    rows = moves(frontier.withColumnRenamed("id", "at"), edges, _AGAINST[direction] if back else direction, edge_types)
    if "way" not in frontier.columns:
        best = rows.select("end", F.col("next").alias("id")).distinct()
    else:
        if back:  # a way leads from the new node over this edge to the old one, and on
            way = F.concat(F.array(F.struct((1 - F.col("dir")).alias("dir"), "edge_pos", F.col("at").alias("id"), F.col("edge_id").alias("via"))), "way")
        else:
            way = F.concat("way", F.array(F.struct("dir", "edge_pos", F.col("next").alias("id"), F.col("edge_id").alias("via"))))
        best = rows.select("end", F.col("next").alias("id"), way.alias("way")).groupBy("end", "id").agg(F.min("way").alias("way"))
    return only_concepts(best.join(seen.select("end", "id"), ["end", "id"], "left_anti"), nodes, edges)


def _cost(frontier: DataFrame, edges: DataFrame | Adjacency, direction: str) -> int:
    """Steps that growing a frontier takes; without an adjacency, its rows."""
    if not isinstance(edges, Adjacency):
        return frontier.count()
    n = {"outgoing": F.col("n_out"), "incoming": F.col("n_steps") - F.col("n_out"), "both": F.col("n_steps")}[direction]
    return frontier.join(edges.degrees, F.col("id") == F.col("at")).agg(F.sum(n)).first()[0] or 0


def _meetings(pairs: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, max_hops: int, direction: str, edge_types: Sequence[str] | None, way: Sequence[Column]) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs (root, target) asked for, each once, and written tables of those that meet: (root, target, hops, and way if an empty ``way`` to begin with is given)."""
    check("path_hops", max_hops)
    edges = served(edges, edge_types)
    wanted = pairs.select("root", "target").distinct()
    targets = nodes.filter("kind = 'Concept'").select(F.col("id").alias("target"))
    asked = materialized(wanted.filter(F.col("root") != F.col("target")))
    targets = of_ids(targets.withColumnRenamed("target", "id"), asked.select(F.col("target").alias("id"))).withColumnRenamed("id", "target")
    asked = materialized(asked.join(targets, "target", "left_semi").select("root", "target"))
    start = lambda c: asked.select(F.col(c).alias("end")).distinct().select("end", F.col("end").alias("id"), *way)
    level = {"root": start("root"), "target": start("target")}
    seen, cost, found, tables = dict(level), {"root": 0}, [], [asked]
    open_, n_open = asked, asked.count()
    for done in range(1, max_hops + 1 if n_open else 1):
        side = min(cost, key=cost.get)
        new = _grown(level[side], seen[side], nodes, edges, direction, edge_types, side == "target")
        tables.append(new)
        level[side], seen[side] = new, seen[side].unionByName(new)
        ahead = level["root"].withColumnsRenamed({"end": "root", "way": "there"})
        behind = level["target"].withColumnsRenamed({"end": "target", "way": "rest"})
        both = open_.join(ahead, "root").join(behind, ["target", "id"]).groupBy("root", "target")
        met = both.agg(F.min(F.concat("there", "rest")).alias("way")) if way else both.agg(F.count(F.lit(1)).alias("n")).drop("n")
        found.append(materialized(met.withColumn("hops", F.lit(done))))
        n_open -= found[-1].count()
        if done == max_hops or not n_open:
            break
        open_ = materialized(asked.join(reduce(DataFrame.unionByName, found), ["root", "target"], "left_anti"))
        tables.append(open_)
        for end in ("root", "target"):
            level[end] = level[end].join(open_.select(F.col(end).alias("end")).distinct(), "end", "left_semi")
            cost[end] = _cost(level[end], edges, _AGAINST[direction] if end == "target" else direction)
        if not min(cost.values()):
            break
    whole = found and materialized(reduce(DataFrame.unionByName, found))
    for table in tables + found:
        dematerialized(table)
    return wanted, [whole] if found else []


def find_hops(pairs: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, max_hops: int = 4, direction: str = "outgoing", edge_types: Sequence[str] | None = None) -> DataFrame:
    """(root, target, hop_count) of :func:`find_paths`: the frontiers carry no ways, so a row is a root and a node only."""
    wanted, found = _meetings(pairs, nodes, edges, max_hops, direction, edge_types, ())
    none = wanted.filter(F.col("root") == F.col("target")).select("root", "target", F.lit(0).alias("hops"))
    hops = reduce(DataFrame.unionByName, found, none).withColumnsRenamed({"root": "_root", "target": "_target"})
    return wanted.join(hops, (F.col("_root") == F.col("root")) & (F.col("_target") == F.col("target")), "left").select("root", "target", F.col("hops").alias("hop_count"))


def find_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, max_hops: int = 4, direction: str = "outgoing", edge_types: Sequence[str] | None = None) -> DataFrame:
    """Shortest paths of the pairs (root, target): (root, target, hop_count, node_ids, edge_ids).

    Of equally short paths the one a queue finds first. A pair of one id is a
    path of no hop; pairs without a path within ``max_hops``, or with a null
    end, have null results; repeated pairs count once. Ways have at most
    ``max_hops`` steps. ``edges`` may be an :class:`Adjacency`.
    """
    pos = (edges.edges if isinstance(edges, Adjacency) else edges).schema["pos"].dataType.simpleString()
    none = F.array().cast(STEPS.format(pos=pos)).alias("way")
    wanted, found = _meetings(pairs, nodes, edges, max_hops, direction, edge_types, (none,))
    ways = wanted.filter(F.col("root") == F.col("target")).select("root", "target", none)
    for met in found:
        ways = ways.unionByName(met.drop("hops"))
    known = wanted.select(F.col("root").alias("_root"), F.col("target").alias("_target")).join(ways, (F.col("_root") == F.col("root")) & (F.col("_target") == F.col("target")), "left")
    there = F.col("way").isNotNull()
    return known.select(
        F.col("_root").alias("root"),
        F.col("_target").alias("target"),
        F.when(there, F.size("way")).alias("hop_count"),
        F.when(there, F.concat(F.array("_root"), F.transform("way", lambda s: s.id))).alias("node_ids"),
        F.when(there, F.transform("way", lambda s: s.via)).alias("edge_ids"),
    )
