"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that later plans start there."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a side that is sent to all tasks.
MOST_SENT = 1 << 18


def few(rows: DataFrame) -> bool:
    """Whether ``rows``, which should be cheap to count, may be sent to all tasks."""
    return rows.limit(MOST_SENT + 1).count() <= MOST_SENT


def is_there(df: DataFrame) -> bool:
    """Whether the files behind a table of :func:`materialized` still exist."""
    sc = df.sparkSession.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()[:1]]
    return all(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p) for p in paths)


def dematerialized(df: DataFrame) -> None:
    """Delete the files behind a table of :func:`materialized` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
