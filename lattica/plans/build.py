"""From a folder of Markdown to graph files: read, validate, project, check, write - each step gated by the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.operators import sinks
from lattica.operators.contract import raise_if_any, violations
from lattica.operators.project import Options, Projection, flat_edges, flat_nodes, project
from lattica.operators.validate import ordered, summary, validate
from lattica.sources.bundle import read_bundle
from lattica.sources.shared import materialized


class InvalidBundle(ValueError):
    """The bundle has errors, or warnings where none are allowed."""


def gate(diagnostics: DataFrame, strict: bool = False, show: int = 5) -> None:
    """Errors always stop; with ``strict`` warnings do too."""
    found = summary(diagnostics).first()
    if found["strict_valid" if strict else "valid"]:
        return
    serious = diagnostics if strict else diagnostics.filter("severity = 'error'")
    named = "; ".join(f"{r['path']}: {r['code']}" for r in ordered(serious).limit(show).collect())
    raise InvalidBundle(f"{found['errors']} errors, {found['warnings']} warnings: {named}")


def build(spark: SparkSession, root: str, options: Options, strict: bool = False) -> tuple[Projection, DataFrame]:
    """The projection of a valid bundle, and its parsed documents; it meets the graph contract."""
    documents, reading = read_bundle(spark, root)
    documents = materialized(documents)
    gate(materialized(validate(documents, reading)), strict)
    made = project(documents, options)
    made = Projection(materialized(made.nodes), materialized(made.edges), made.manifest)
    raise_if_any(violations(made.nodes, made.edges))
    return made, documents


def export(made: Projection, base: str) -> str:
    """Publish nodes and edges under their projection's id, the contract checked once more before anything is written."""
    raise_if_any(violations(made.nodes, made.edges))
    one = made.manifest.select("projectionId", "commitSha").first()
    return sinks.publish(made.nodes.drop("pos"), made.edges.drop("pos"), base, one["projectionId"], one["commitSha"])


def export_files(made: Projection, path: str) -> None:
    """The projection as JSON lines below ``path``, the contract checked first.

    ``nodes`` and ``edges`` are the typed rows, ``flat_nodes`` and ``flat_edges``
    the scalar ones, all in the order of their positions over the part files;
    ``manifest`` is one line. A later part file's rows come after an earlier one's.
    """
    raise_if_any(violations(made.nodes, made.edges))
    base = path.rstrip("/")
    tables = {"nodes": made.nodes.orderBy("pos").drop("pos"), "edges": made.edges.orderBy("pos").drop("pos"), "flat_nodes": flat_nodes(made.nodes, made.manifest, True), "flat_edges": flat_edges(made.edges, True), "manifest": made.manifest}
    for name, rows in tables.items():
        sinks.write_ndjson(rows, f"{base}/{name}")
