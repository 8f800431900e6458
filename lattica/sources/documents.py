"""Documents of a pinned commit, read from a local or shared folder within fixed bounds."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a document.
MOST_BYTES = 2 << 20


class Refused(ValueError):
    """A path or a document is outside of what may be read."""


def allowed(path: str) -> bool:
    """A relative Markdown path that stays below its root."""
    parts = path.split("/")
    return path.lower().endswith(".md") and "\\" not in path and "\0" not in path and not any(p in ("", ".", "..") for p in parts)


def read_documents(spark: SparkSession, root: str, paths: Sequence[str], commit: str, pinned: str) -> DataFrame:
    """(path, raw, commitSha) of Markdown files under ``root``.

    ``commit`` must be the one that the folder is ``pinned`` to. Paths that are
    not relative ``.md`` paths below the root, on a local folder also links that
    lead out of it, files of more than ``MOST_BYTES`` bytes, missing ones and
    ones that are not UTF-8 raise :class:`Refused`.
    """
    if commit != pinned:
        raise Refused(f"commit {commit} is not the pinned one")
    wanted = list(dict.fromkeys(paths))
    for path in wanted:
        if not allowed(path):
            raise Refused(f"{path}: not a Markdown path below the root")
    base = root.rstrip("/")
    plain = base.removeprefix("file://")
    if plain.startswith("/") and os.path.isdir(plain):
        top = os.path.realpath(plain) + os.sep
        for path in wanted:
            if not os.path.realpath(os.path.join(plain, path)).startswith(top):
                raise Refused(f"{path}: leads out of the root")
    if not wanted:
        return spark.createDataFrame([], "path string, raw string, commitSha string")
    try:
        files = spark.read.format("binaryFile").load([f"{base}/{p}" for p in wanted])
        sizes = {r["path"]: r["length"] for r in files.select("path", "length").collect()}  # as many as were asked for
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise Refused("a document is missing") from e
        raise
    if large := [p for p, n in sizes.items() if n > MOST_BYTES]:
        raise Refused(f"{large[0]}: more than {MOST_BYTES} bytes")
    relative = F.element_at(F.filter(F.array(*[F.lit(p) for p in wanted]), lambda p: F.endswith(F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), F.concat(F.lit("/"), p))), 1)
    rows = files.select(relative.alias("path"), F.col("content"))
    if rows.filter(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count():
        raise Refused("a document is not UTF-8")
    return rows.select("path", F.decode("content", "UTF-8").alias("raw"), F.lit(commit).alias("commitSha"))
