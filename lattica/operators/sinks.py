"""Sinks: newline-delimited JSON, tables with readback, versioned publishing, receipts."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.contract import ContractError, single_value


class Conflict(RuntimeError):
    """The target exists with other content."""


def write_ndjson(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept; existing output is replaced when the job commits."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def digest(rows: DataFrame) -> tuple[int, str]:
    """Row count and an order-free digest of all rows: it needs one small row from each task only."""
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    h = rows.select(F.sha2(text, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    r = h.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return r["n"], "-".join(str(r[f"p{k}"] or 0) for k in range(8))


def overwrite_with_readback(rows: DataFrame, path: str, allow_empty: bool = False, single: tuple[str, ...] = ("projectionId", "commitSha")) -> int:
    """Replace a table, then read it back: the count must agree and the named columns must hold one value."""
    expected = rows.count()
    if not expected and not allow_empty:
        raise ContractError("no rows to write")
    rows.write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if (n := back.count()) != expected:
        raise ContractError(f"{path}: wrote {expected} rows, read {n}")
    for column in single if expected else ():
        single_value(back, column)
    return n


def publish(nodes: DataFrame, edges: DataFrame, root: str, projection_id: str, commit_sha: str) -> str:
    """Publish both tables of a projection and commit as one: returns their folder below ``root``.

    The tables are written aside, each publisher into a folder of its own, and
    read back. One manifest, renamed into place last, makes them the tables of
    this projection and commit; a second publisher finds it and is accepted only
    if its rows are the same. Then the root's pointer is replaced in one rename.
    Whatever stops on the way, readers see the old tables or the new, never a mix.
    """
    spark = nodes.sparkSession
    at = f"{root.rstrip('/')}/{projection_id.rsplit(':', 1)[-1]}/{commit_sha}"
    tables = {"nodes": nodes, "edges": edges}
    wanted = {name: list(digest(rows)) for name, rows in tables.items()}
    if (held := _read(spark, f"{at}/{MANIFEST}")) is None:
        aside = f"generation-{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{at}/{aside}/{name}")
            if list(digest(spark.read.schema(rows.schema).parquet(f"{at}/{aside}/{name}"))) != wanted[name]:
                raise Conflict(f"{at}/{aside}/{name}: read back other rows than were written")
        held = {"folder": aside, "tables": wanted}
        if not _renamed(spark, held, f"{at}/{MANIFEST}", replace=False):  # another publisher was first
            _delete(spark, f"{at}/{aside}")
            held = _read(spark, f"{at}/{MANIFEST}")
    for name, rows in wanted.items():
        if held["tables"][name] != rows:
            raise Conflict(f"{at}: {name}")
    _renamed(spark, {"at": at.removeprefix(root.rstrip("/") + "/")}, f"{root.rstrip('/')}/{POINTER}", replace=True)
    return at


def published(spark: SparkSession, root: str, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that are current below ``root``, or those of one published folder."""
    if at is None:
        if (pointer := _read(spark, f"{root.rstrip('/')}/{POINTER}")) is None:
            raise FileNotFoundError(f"nothing is published below {root}")
        at = f"{root.rstrip('/')}/{pointer['at']}"
    if (held := _read(spark, f"{at}/{MANIFEST}")) is None:
        raise FileNotFoundError(f"{at} is not published")
    nodes, edges = (spark.read.parquet(f"{at}/{held['folder']}/{name}") for name in ("nodes", "edges"))
    return nodes, edges


#: The small files that say what is published: of a projection and commit, and of a root.
MANIFEST, POINTER = "manifest.json", "current.json"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict | None:
    """The JSON object in a small file, if it is there."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _renamed(spark: SparkSession, value: dict, path: str, replace: bool) -> bool:
    """Write a small file aside and rename it into place; false if another is there and is not to be replaced."""
    aside, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if replace else kind.NONE
    target = _path(spark, path)[0]
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, options)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def receipt(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (status, projectionId, commitSha, nodeCount, edgeCount)."""
    counted = nodes.agg(F.first("projectionId").alias("projectionId"), F.first("commitSha").alias("commitSha"), F.count(F.lit(1)).alias("nodeCount"))
    return counted.crossJoin(edges.agg(F.count(F.lit(1)).alias("edgeCount"))).select(F.lit("loaded").alias("status"), "projectionId", "commitSha", "nodeCount", "edgeCount")
