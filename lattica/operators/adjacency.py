"""Adjacency of a graph in blocks: a hub's steps lie in many blocks, so looking them up is spread over tasks.

``steps`` holds every step from a node to a neighbouring Concept in the order of
(node, direction, edge), numbered over all nodes; a block is a fixed run of these
numbers. ``degrees`` says where a node's steps begin and how many there are. A
lookup turns each node into its few block numbers and joins on (block, node): no
join key has more rows than a block, and a lookup of a node's first steps reads
its first blocks only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.ordinals import numbered
from lattica.sources.shared import dematerialized, materialized

#: Steps of a block.
BLOCK = 1024
OUT, IN = 0, 1
DIRECTIONS = ("outgoing", "incoming", "both")


@dataclass(frozen=True)
class Adjacency:
    """``edges`` as given, ``steps`` (at, dir, next, edge_pos, edge_id, nth, block) and ``degrees`` (at, start, n_out, n_steps), both written."""

    edges: DataFrame
    steps: DataFrame
    degrees: DataFrame
    edge_types: tuple[str, ...] | None = None
    block: int = BLOCK

    def serves(self, edge_types: Sequence[str] | None) -> bool:
        """Whether it holds the steps of just these edge types. By the edge matrix LINKS_TO alone joins Concepts, so no filter is as good."""
        wanted = tuple(sorted(set(edge_types))) if edge_types else None
        return wanted == self.edge_types or {wanted, self.edge_types} == {None, ("LINKS_TO",)}

    def release(self) -> None:
        for table in (self.steps, self.degrees):
            dematerialized(table)


def adjacency(nodes: DataFrame, edges: DataFrame, edge_types: Sequence[str] | None = None, block: int = BLOCK) -> Adjacency:
    """The adjacency of ``edges`` (of some types) between Concepts.

    Of parallel edges in one direction only the first is a step: a walk never
    takes another. Ends that are null or no Concept give no step to them; a node
    of any kind may be stepped from.
    """
    some = edges.filter(F.col("type").isin(list(edge_types))) if edge_types else edges
    ends = lambda d, a, b: some.select(F.col(a).alias("at"), F.lit(d).alias("dir"), F.col(b).alias("next"), F.col("pos").alias("edge_pos"), F.col("id").alias("edge_id"))
    every = ends(OUT, "from", "to").unionByName(ends(IN, "to", "from")).filter("at is not null")
    concepts = nodes.filter("kind = 'Concept'").select(F.col("id").alias("next"))
    first = every.join(concepts, "next", "left_semi").groupBy("at", "dir", "next").agg(F.min(F.struct("edge_pos", "edge_id")).alias("e"))
    ordered = numbered(first.select("at", "dir", "next", "e.*"), [F.col("at"), F.col("dir"), F.col("edge_pos"), F.col("next")], "nth")
    steps = ordered.withColumn("block", F.expr(f"nth div {block}"))
    degrees = materialized(steps.groupBy("at").agg(F.min("nth").alias("start"), F.count_if(F.col("dir") == OUT).alias("n_out"), F.count(F.lit(1)).alias("n_steps")))
    return Adjacency(edges, steps, degrees, tuple(sorted(set(edge_types))) if edge_types else None, block)


def steps_from(frontier: DataFrame, links: Adjacency, direction: str, most: int | None = None) -> DataFrame:
    """``frontier`` (at, ...) with each step of its nodes: adds next, dir, edge_pos, edge_id.

    ``most`` reads only the first so many steps of each node, outgoing ones first.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    known = links.degrees.withColumnRenamed("at", "_at")
    begin = F.col("start") + F.col("n_out") if direction == "incoming" else F.col("start")
    end = F.col("start") + (F.col("n_out") if direction == "outgoing" else F.col("n_steps"))
    rows = frontier.join(known, F.col("at") == F.col("_at")).withColumn("_begin", begin)
    rows = rows.withColumn("_end", end if most is None else F.least(end, F.col("_begin") + most)).filter("_begin < _end").drop("_at", "start", "n_out", "n_steps")
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.expr(f"_begin div {links.block}"), F.expr(f"(_end - 1) div {links.block}"))))
    there = links.steps.withColumnRenamed("at", "_at")
    met = blocks.join(there, (F.col("_block") == F.col("block")) & (F.col("at") == F.col("_at"))).filter("nth >= _begin and nth < _end")
    return met.select(*frontier.columns, "next", "dir", "edge_pos", "edge_id")
