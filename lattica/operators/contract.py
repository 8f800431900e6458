"""The graph contract: all violations as one DataFrame, and a gate that raises."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import is_iso_datetime, utf16_length
from lattica.operators.graph import of_ids
from lattica.schema import EDGE_KINDS, HASH_PATTERN, ID_PATTERN, KINDS, LENGTHS, LIST_LIMITS, MAX_EDGES, MAX_NODES, MAX_SAFE_INTEGER, SHA_PATTERN, STATUSES
from lattica.sources.shared import MOST_SENT, materialized


class ContractError(ValueError):
    """A graph breaks its contract."""


def _violations(rows: DataFrame, rules: dict[str, Column], subject: str = "id") -> DataFrame:
    """(rule, subject) of each rule that holds for a row; one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.col(subject).cast("string").alias("subject"))


def is_relative_path(c: str) -> Column:
    """Relative, without empty, ``.`` or ``..`` segments or backslashes."""
    return ~F.contains(F.col(c), F.lit("\\")) & ~F.exists(F.split(c, "/"), lambda s: s.isin("", ".", ".."))


def _outside(low: int, high: int):
    """Whether a text's length lies outside these bounds, as a lambda over array items."""
    return lambda s: ~utf16_length(s).between(low, high)


def node_rules() -> dict[str, Column]:
    concept = F.col("kind") == "Concept"
    rules = {
        "id_pattern": F.col("id").isNull() | ~F.col("id").rlike(ID_PATTERN),
        "kind": F.col("kind").isNull() | ~F.col("kind").isin(*KINDS),
        "type_is_kind": ~concept & (F.col("type") != F.col("kind")),
        "title_missing": F.col("title").isNull(),
        "commit_pattern": ~F.coalesce(F.col("commitSha").rlike(SHA_PATTERN), F.lit(False)),
        "status": concept & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "content_hash": concept & ~F.coalesce(F.col("contentHash").rlike(HASH_PATTERN), F.lit(False)),
        "path": concept & ~F.coalesce(is_relative_path("path"), F.lit(False)),
        "repository_path": concept & ~F.coalesce(is_relative_path("repositoryPath"), F.lit(False)),
        "tags_of_kind": ~concept & (F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0),
        "usage_counts": (F.size("usageCounts") > 100) | F.exists("usageCounts", lambda n: (n < 0) | (n > MAX_SAFE_INTEGER)),
        "last_modified": F.col("lastModified").isNotNull() & ~is_iso_datetime("lastModified"),
    }
    for name, (low, high) in LENGTHS.items():
        rules[f"length_{name}"] = F.col(name).isNotNull() & ~utf16_length(name).between(low, high)
    for name, (items, length) in LIST_LIMITS.items():
        rules[f"list_{name}"] = (F.size(name) > items) | F.exists(name, _outside(1, length))
    return rules


# Fixed columns of flat rows that hold a value in every row.
POPULATED_NODES = ("id", "kind", "projectionId", "commitSha", "repository", "projectionGeneratedAt", "okfVersion")
POPULATED_EDGES = ("id", "from", "to", "type", "projectionId", "commitSha")


def unpopulated(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n) of the columns that are null or empty in some of the flat ``rows``, and in how many; one pass."""
    empty = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.length(c) == 0), F.lit(c)) for c in columns]))
    return rows.select(F.explode(empty).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, missing) of edge ends that no node has."""
    ends = edges.select(F.col("id").alias("edge_id"), F.explode(F.array("from", "to")).alias("missing"))  # one reading of the edges
    return ends.join(nodes.select(F.col("id").alias("missing")), "missing", "left_anti").select("edge_id", "missing")


def kind_mismatches(nodes: DataFrame, edges: DataFrame, matrix: dict[str, tuple[str, str]] = EDGE_KINDS) -> DataFrame:
    """Edges whose type and end kinds are not a row of the matrix.

    An edge can only be one if its type is not in the matrix or one of its ends
    is of another kind than the type's. Where such nodes are few they are sent to
    all tasks and only the edges at them are joined with the kinds of both ends.
    """
    spark = edges.sparkSession
    allowed = F.broadcast(spark.createDataFrame([(t, *k) for t, k in matrix.items()], "type string, from_kind string, to_kind string"))  # a few fixed rows
    kind = nodes.select("id", "kind")
    per_kind = {r["kind"]: r["count"] for r in kind.groupBy("kind").count().collect()}
    common = max(per_kind, key=lambda k: per_kind[k], default=None)
    rare = kind.filter(~F.col("kind").eqNullSafe(F.lit(common))).select("id").distinct()
    if sum(n for k, n in per_kind.items() if k != common) <= MOST_SENT:
        # an edge between two nodes of the common kind is one by its type alone
        usual = [t for t, kinds in matrix.items() if kinds == (common, common)]
        sent = F.broadcast(rare.withColumnRenamed("id", "_rare"))
        at = lambda end: edges.join(sent, F.col(end) == F.col("_rare"), "left_semi")
        other = ~F.coalesce(F.col("type").isin(usual), F.lit(False))
        edges = edges.filter(other).unionByName(at("from").filter(~other)).unionByName(at("to").join(sent, F.col("from") == F.col("_rare"), "left_anti").filter(~other))
        edges = materialized(edges.select("id", "type", "from", "to"))
        ends = edges.select(F.explode(F.array("from", "to")).alias("id"))
        kind = of_ids(kind, ends)
    placed = edges.select(F.col("id").alias("edge_id"), "type", "from", "to").join(kind.toDF("from", "from_kind"), "from").join(kind.toDF("to", "to_kind"), "to")
    return placed.join(allowed, ["type", "from_kind", "to_kind"], "left_anti").select("edge_id", "type", "from_kind", "to_kind")


def repeated(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n <> 1")


def single_value(rows: DataFrame, column: str) -> str:
    """The one value of a column; an error if there are none or several."""
    found = rows.select(column).distinct().limit(2).collect()
    if len(found) != 1 or found[0][0] is None:
        raise ContractError(f"{column}: exactly one value expected")
    return found[0][0]


def within_limit(rows: DataFrame, limit: int, name: str) -> None:
    """Fewer rows than the limit: as many may have been cut off."""
    if rows.limit(limit).count() >= limit:
        raise ContractError(f"{name}: {limit} rows or more, the result may be incomplete")


def violations(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, expected: dict[str, str] | None = None) -> DataFrame:
    """(rule, subject) of everything that breaks the contract.

    ``expected`` names the projectionId or commitSha that all rows must have,
    say those of the snapshot's source; its rule's subjects are the other values.
    """
    named = lambda rows, rule, subject: rows.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    edge_rules = {"edge_type": ~F.coalesce(F.col("type").isin(*EDGE_KINDS), F.lit(False)), "edge_id_length": ~F.coalesce(utf16_length("id").between(1, 512), F.lit(False)), "edge_label_length": F.col("label").isNotNull() & ~utf16_length("label").between(1, 300)}
    same = lambda column: nodes.select(column).unionByName(edges.select(column)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    several = [named(same(c).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("v")).filter("n > 1"), f"several_{c}", "v") for c in ("projectionId", "commitSha")]
    counts = [named(rows.agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > most) | (F.col("n") < least)), rule, "n") for rows, rule, least, most in ((nodes, "node_count", 1, max_nodes), (edges, "edge_count", 0, max_edges))]
    several += [named(same(c).filter(~F.col(c).eqNullSafe(F.lit(value))), f"unexpected_{c}", c) for c, value in (expected or {}).items()]
    repeats = [named(repeated(nodes), "repeated_node", "id"), named(repeated(edges), "repeated_edge", "id"), named(repeated(nodes.filter("kind = 'Concept'"), "path"), "repeated_path", "path")]
    ends = edges.groupBy("type", "from", "to").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n > 1")
    return reduce(DataFrame.unionByName, [_violations(nodes, node_rules()), _violations(edges, edge_rules), *several, *counts, *repeats, named(ends, "repeated_ends", "id"), named(dangling(nodes, edges), "dangling", "edge_id"), named(kind_mismatches(nodes, edges), "kind_matrix", "edge_id")])


def raise_if_any(found: DataFrame, show: int = 5) -> None:
    """The gate: an error that names the first violations."""
    if rows := found.orderBy("rule", "subject").limit(show).collect():
        raise ContractError("; ".join(f"{r['rule']}: {r['subject']}" for r in rows))
