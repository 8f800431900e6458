"""Schemas and limits of the property graph: one place, no inference."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

# Fixed values of the graph contract: kinds, edge types with their end kinds, statuses, limits.
KINDS = ("Concept", "Tag", "Source", "Term")
EDGE_KINDS = {"LINKS_TO": ("Concept", "Concept"), "HAS_TAG": ("Concept", "Tag"), "DERIVED_FROM": ("Concept", "Source"), "ALIASED_AS": ("Concept", "Term")}
STATUSES = ("draft", "stable", "deprecated")
MAX_NODES, MAX_EDGES = 100_000, 500_000
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:/#-]{0,511}$"
SHA_PATTERN = r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
HASH_PATTERN = r"^[0-9a-f]{64}$"
LENGTHS = {"title": (1, 1024), "type": (1, 100), "path": (1, 1024), "repositoryPath": (1, 1024), "conceptId": (1, 1024), "summary": (0, 4000), "resource": (1, 4096), "normalizedValue": (1, 1024)}
LIST_LIMITS = {"tags": (100, 300), "aliases": (100, 1024), "sourceIds": (100, 1024), "authors": (100, 1024)}
MAX_SAFE_INTEGER = 2**53 - 1

NODE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "kind", "title", "type")]
    + [T.StructField(n, STRINGS) for n in ("tags", "aliases")]
    + [T.StructField(n, T.StringType()) for n in ("commitSha", "projectionId", "path", "repositoryPath", "conceptId", "summary", "resource", "status", "contentHash", "sourceUrl", "normalizedValue")]
    + [T.StructField("sourceIds", STRINGS), T.StructField("authors", STRINGS), T.StructField("usageCounts", T.ArrayType(T.LongType())), T.StructField("lastModified", T.StringType())]
)
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "from", "to", "type", "projectionId", "commitSha", "label", "sourcePath")])
SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("repository", "projectionId", "commitSha", "generatedAt")])
SNAPSHOT = T.StructType([T.StructField("schemaVersion", T.StringType()), T.StructField("okfVersion", T.StringType()), T.StructField("source", SOURCE), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])

# Fixed order of the flat row's columns.
FLAT_NODE_COLUMNS = (
    "id",
    "kind",
    "title",
    "type",
    "path",
    "repositoryPath",
    "conceptId",
    "tagsJson",
    "aliasesJson",
    "projectionId",
    "commitSha",
    "repository",
    "projectionGeneratedAt",
    "okfVersion",
    "summary",
    "resource",
    "status",
    "contentHash",
    "sourceUrl",
    "normalizedValue",
    "sourceIdsJson",
    "authorsJson",
    "usageCountsJson",
    "lastModified",
)
FLAT_EDGE_COLUMNS = ("id", "from", "to", "type", "projectionId", "commitSha", "label", "sourcePath")
FLAT_NODE = T.StructType([T.StructField(n, T.StringType()) for n in FLAT_NODE_COLUMNS])
FLAT_EDGE = T.StructType([T.StructField(n, T.StringType()) for n in FLAT_EDGE_COLUMNS])

LINK = T.StructType([T.StructField("label", T.StringType()), T.StructField("target", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
DIAGNOSTIC = T.StructType([T.StructField(n, T.StringType()) for n in ("severity", "code", "message", "path")] + [T.StructField(n, T.IntegerType()) for n in ("line", "column")])
