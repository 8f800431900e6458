"""Python data sources: a bundle's folder tree with its symbolic links, and a curated snapshot behind a URL."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.schema import EDGE, NODE

#: Files and bytes of one task; at least one file.
TASK_FILES, TASK_BYTES = 2000, 64 << 20
EXCLUDED = (".git", "node_modules")
#: Most bytes of a snapshot, and how long to wait for it.
MOST_BYTES, TIMEOUT_MS = 256 << 20, 15_000


# ----------------------------------------------------------------- bundle tree


@dataclass
class Files(InputPartition):
    """Paths of one task's files, in folder order, and whether each is a symbolic link."""

    paths: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Files]:
        """Folders are listed one after another; their files are dealt to tasks in that order, by number and size."""
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        out, size, folders = [Files([])], 0, [""]
        while folders:
            folder = folders.pop()
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in sorted(entries, key=lambda e: e.name):
                    path, link = (f"{folder}/{entry.name}" if folder else entry.name), entry.is_symlink()
                    if not link and entry.is_dir(follow_symlinks=False):
                        if entry.name not in EXCLUDED:
                            folders.append(path)
                        continue
                    if not link and not (entry.is_file(follow_symlinks=False) and entry.name.lower().endswith(".md")):
                        continue
                    own = 0 if link else entry.stat(follow_symlinks=False).st_size
                    if out[-1].paths and (len(out[-1].paths) >= TASK_FILES or size + own > TASK_BYTES):
                        out.append(Files([]))
                        size = 0
                    out[-1].paths.append((path, link))
                    size += own
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, link in partition.paths:
            if link:
                yield path, None, True
                continue
            with open(os.path.join(self.root, path), "rb", opener=lambda p, flags: os.open(p, flags | os.O_NOFOLLOW)) as f:
                yield path, f.read(), False


class BundleTree(DataSource):
    """``bundle_tree``: the Markdown files below option ``root`` and every symbolic link (null content); links are not followed."""

    @classmethod
    def name(cls) -> str:
        return "bundle_tree"

    def schema(self) -> str:
        return "path string, content binary, is_link boolean"

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(self.options["root"])


def local_path(root: str) -> str | None:
    """The folder of a local path or file URL; null for any other store."""
    parts = urllib.parse.urlsplit(root)
    if parts.scheme == "file":
        return urllib.parse.unquote(parts.path)
    return root if not parts.scheme else None


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, is_link) of the files below a folder that all nodes see, without ``.git`` and ``node_modules``."""
    spark.dataSource.register(BundleTree)
    return spark.read.format("bundle_tree").option("root", root.rstrip("/") or "/").load()


# ------------------------------------------------------------ curated snapshot


class SourceError(RuntimeError):
    """The endpoint can't be read, or what it sends is no snapshot."""


def checked_url(url: str, allow_insecure_localhost: bool = False) -> str:
    """An https address without credentials, or plain http of this host where that is allowed."""
    parts = urllib.parse.urlsplit(url)
    here = parts.hostname in ("localhost", "127.0.0.1", "::1")
    if not parts.hostname or parts.username or parts.password or not (parts.scheme == "https" or parts.scheme == "http" and here and allow_insecure_localhost):
        raise ValueError("a snapshot is read by https, or by http from this host if that is allowed, without credentials in its address")
    return url


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):  # another address was not checked
        return None


def fetched(url: str, token: str | None, timeout_ms: int, most: int) -> dict:
    """The JSON object at ``url``, of at most ``most`` bytes."""
    request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    try:
        with urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout_ms / 1000) as answer:
            raw = answer.read(most + 1)
    except (urllib.error.URLError, TimeoutError) as e:
        raise SourceError(f"the snapshot endpoint fails: {getattr(e, 'code', None) or type(e).__name__}") from None
    if len(raw) > most:
        raise SourceError(f"the snapshot has more than {most} bytes")
    try:
        value = json.loads(raw)
    except ValueError:
        raise SourceError("the snapshot is no JSON") from None
    if not isinstance(value, dict) or not all(isinstance(value.get(k), list) and all(isinstance(x, dict) for x in value[k]) for k in ("nodes", "edges")) or not isinstance(value.get("source"), dict):
        raise SourceError("the snapshot has no nodes, edges and source")
    return value


_SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("schemaVersion", "okfVersion", "repository", "projectionId", "commitSha", "generatedAt")])
_TABLES = {
    "nodes": T.StructType([T.StructField("pos", T.IntegerType()), *NODE.fields]),
    "edges": T.StructType([T.StructField("pos", T.IntegerType()), *EDGE.fields]),
    "source": _SOURCE,
}


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        value = fetched(o["url"], o.get("token"), int(o.get("timeoutms", TIMEOUT_MS)), int(o.get("mostbytes", MOST_BYTES)))
        if o["table"] == "source":
            whole = value["source"] | {k: value.get(k) for k in ("schemaVersion", "okfVersion")}
            yield tuple(whole.get(c) for c in _SOURCE.names)
            return
        names = _TABLES[o["table"]].names[1:]
        for pos, row in enumerate(value[o["table"]]):
            yield (pos, *(row.get(c) for c in names))


class GraphSnapshot(DataSource):
    """``graph_snapshot``: table ``nodes``, ``edges`` or ``source`` of the snapshot at option ``url``; the contract bounds its size."""

    @classmethod
    def name(cls) -> str:
        return "graph_snapshot"

    def schema(self) -> T.StructType:
        return _TABLES[self.options["table"]]

    def reader(self, schema: T.StructType) -> SnapshotReader:
        checked_url(self.options["url"], self.options.get("allowinsecurelocalhost", "false").lower() == "true")
        return SnapshotReader(self.options)


def read_curated_snapshot(spark: SparkSession, url: str, token: str | None = None, timeout_ms: int = TIMEOUT_MS, most_bytes: int = MOST_BYTES, allow_insecure_localhost: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (with ``pos``) and the one-row source of the snapshot at ``url``."""
    checked_url(url, allow_insecure_localhost)
    spark.dataSource.register(GraphSnapshot)
    options = {"url": url, "timeoutMs": str(timeout_ms), "mostBytes": str(most_bytes), "allowInsecureLocalhost": str(allow_insecure_localhost)} | ({"token": token} if token else {})
    nodes, edges, source = (spark.read.format("graph_snapshot").options(table=table, **options).load() for table in ("nodes", "edges", "source"))
    return nodes, edges, source
