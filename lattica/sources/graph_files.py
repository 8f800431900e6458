"""Graph files: snapshot JSON, flat newline-delimited JSON with an exact schema, questions and gold cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.schema import EDGE, FLAT_EDGE, FLAT_NODE, NODE, SNAPSHOT


class SchemaMismatch(ValueError):
    """A file does not have the exact schema asked for."""


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (with their ordinal ``pos``) and the one-row source of a snapshot file."""
    whole = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = whole.select(F.posexplode("nodes").alias("pos", "n")).select("pos", *[F.col(f"n.{c}").alias(c) for c in NODE.names])
    edges = whole.select(F.posexplode("edges").alias("pos", "e")).select("pos", *[F.col("e")[c].alias(c) for c in EDGE.names])
    return nodes, edges, whole.select("schemaVersion", "okfVersion", "source.*")


def read_exact_ndjson(spark: SparkSession, path: str, schema: T.StructType, allow_empty: bool = False) -> DataFrame:
    """Rows of a file whose every line is an object of exactly the schema's keys, values texts or null.

    Nested values and repeated keys are refused too.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    expected = F.array(*[F.lit(c) for c in sorted(schema.names)])
    keys = F.json_object_keys("value")
    variant = F.try_parse_json("value")
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(variant, f"$['{c}']", "variant")), F.lit("VOID")) for c in schema.names]
    wrong = F.coalesce(F.array_sort(keys) != expected, F.lit(True)) | variant.isNull()
    for kind in kinds:
        wrong |= ~kind.isin("STRING", "VOID")
    bad = lines.filter(wrong).limit(1).collect()
    if bad:
        raise SchemaMismatch(f"{path}: not the exact schema: {bad[0]['value'][:200]}")
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    if not allow_empty and not rows.limit(1).count():
        raise SchemaMismatch(f"{path}: no row")
    return rows


def read_flat_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Flat node and edge rows; the edge file may be empty, the node file may not."""
    return read_exact_ndjson(spark, nodes, FLAT_NODE), read_exact_ndjson(spark, edges, FLAT_EDGE, allow_empty=True)


def decode_flat(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed nodes and edges of flat rows: JSON texts to arrays, empty texts to null, by kind."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    listed = lambda c, kind="array<string>": F.coalesce(F.from_json(F.col(c), kind), F.array().cast(kind))
    concept, source = F.col("kind") == "Concept", F.col("kind") == "Source"
    known = nodes.select(
        *[text(c).alias(c) for c in ("id", "kind", "title", "type", "commitSha", "projectionId")],
        listed("tagsJson").alias("tags"),
        listed("aliasesJson").alias("aliases"),
        *[F.when(concept, text(c)).alias(c) for c in ("path", "repositoryPath", "conceptId", "summary", "status", "contentHash", "sourceUrl")],
        F.when(concept | source, text("resource")).alias("resource"),
        F.when(F.col("kind").isin("Tag", "Term"), text("normalizedValue")).alias("normalizedValue"),
        *[F.when(source, listed(c)).alias(a) for c, a in (("sourceIdsJson", "sourceIds"), ("authorsJson", "authors"))],
        F.when(source, listed("usageCountsJson", "array<bigint>")).alias("usageCounts"),
        F.when(source, text("lastModified")).alias("lastModified"),
    )
    return known, edges.select(*[text(c).alias(c) for c in EDGE.names])


def stored_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges as a graph store returns them: ends come from the joined nodes, so dangling edges vanish."""
    ends = nodes.select(F.col("id"))
    return edges.join(ends.withColumnRenamed("id", "from"), "from", "left_semi").join(ends.withColumnRenamed("id", "to"), "to", "left_semi")


QUESTION = "struct<id:string,query:string,terms:array<string>,focus_concept_uid:string,allowed_statuses:array<string>,top_k:int,max_hops:int>"
GOLD = "struct<question_id:string,required_concept_uids:array<string>,excluded_concept_uids:array<string>,required_statuses:map<string,string>,required_paths:array<array<string>>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their defaults: stable only, 12 results, 2 hops."""
    rows = spark.read.schema(f"schema_version string, dataset_version string, questions array<{QUESTION}>").option("multiLine", True).json(path)
    q = rows.select(F.posexplode("questions").alias("pos", "q")).select("pos", "q.*")
    return q.withColumns({"allowed_statuses": F.coalesce("allowed_statuses", F.array(F.lit("stable"))), "top_k": F.coalesce("top_k", F.lit(12)), "max_hops": F.coalesce("max_hops", F.lit(2))})


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"schema_version string, dataset_version string, expected_commit_sha string, cases array<{GOLD}>").option("multiLine", True).json(path)
    return rows.select("expected_commit_sha", F.posexplode("cases").alias("pos", "c")).select("expected_commit_sha", "pos", "c.*")
