"""Immutable snapshots, and a manager that renews them after a time to live."""

from __future__ import annotations

import threading
import time
import weakref
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lattica.operators import graph, paths
from lattica.operators.adjacency import Adjacency, adjacency
from lattica.operators.contract import raise_if_any, violations
from lattica.sources.shared import dematerialized, materialized


@dataclass(frozen=True)
class Snapshot:
    """Nodes and edges of one generation, with their ordinals; every query of it sees the same rows."""

    nodes: DataFrame
    edges: DataFrame
    repository: str = ""
    commit_sha: str = ""
    held: dict = field(default_factory=dict, compare=False, repr=False)

    def links(self, edge_types: Sequence[str] | None = None) -> Adjacency:
        """The adjacency of these edge types, built when first asked for and kept with the snapshot."""
        key = tuple(sorted(edge_types)) if edge_types else None
        if key not in self.held:
            self.held[key] = adjacency(self.nodes, self.edges, edge_types)
        return self.held[key]

    def pinned(self) -> Snapshot:
        """The same rows written to the shared folder: whatever its sources become, every query of it reads these."""
        return Snapshot(materialized(self.nodes), materialized(self.edges), self.repository, self.commit_sha)

    def release(self) -> None:
        """Delete the files of a pinned snapshot."""
        for table in (self.nodes, self.edges):
            dematerialized(table)
        while self.held:
            self.held.popitem()[1].release()

    def browse_index(self, directory: str = ".", **options) -> DataFrame:
        return graph.browse(self.nodes, directory, **options)

    def resolve_concepts(self, terms: Sequence[str], **options) -> DataFrame:
        return graph.resolve(self.nodes, terms, **options)

    def _roots(self, ids: Sequence[str]) -> DataFrame:
        graph.require(self.nodes, ids)
        return self.nodes.sparkSession.createDataFrame([(i,) for i in ids], "root string")

    def get_neighbors(self, concept_id: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph.neighbors(self._roots([concept_id]), self.nodes, self.links(options.get("edge_types")), **options)

    def get_backlinks(self, concept_id: str, **options) -> DataFrame:
        graph.require(self.nodes, [concept_id])
        return graph.backlinks(concept_id, self.nodes, self.edges, **options)

    def find_path(self, start: str, end: str, **options) -> DataFrame:
        graph.require(self.nodes, [start, end])
        pairs = self.nodes.sparkSession.createDataFrame([(start, end)], "root string, target string")
        return paths.find_paths(pairs, self.nodes, self.links(options.get("edge_types")), **options)

    def read_concepts(self, ids: Sequence[str], documents: DataFrame, **options) -> DataFrame:
        return graph.read_concepts(ids, self.nodes, documents, **options)

    def trace_provenance(self, concept_id: str) -> DataFrame:
        graph.require(self.nodes, [concept_id])
        return graph.provenance([concept_id], self.nodes, self.edges)


class SnapshotManager:
    """Hands out the current snapshot; loads a new one when the time to live (1 to 300 s) is over.

    One load at a time. A load that fails, or breaks the contract, raises and
    leaves the old snapshot to queries that hold it; it is not served anew. A
    snapshot is written once, when it is loaded, and its files go when a newer
    one has taken its place and its last reader has ended: hold the snapshot of
    :meth:`acquire`, or stay within :meth:`reading`, until results are read.
    """

    def __init__(self, load: Callable[[], Snapshot], ttl: float = 60, validate: bool = True, clock: Callable[[], float] = time.monotonic):
        if not 1 <= ttl <= 300:
            raise ValueError("ttl lies between 1 and 300 seconds")
        self._load, self._ttl, self._validate, self._clock = load, ttl, validate, clock
        self._lock = threading.Lock()
        self._current: Snapshot | None = None
        self._until = float("-inf")

    def acquire(self) -> Snapshot:
        with self._lock:
            if self._current is None or self._clock() >= self._until:
                new = self._load().pinned()
                if self._validate:
                    try:
                        raise_if_any(violations(new.nodes, new.edges))
                    except Exception:
                        new.release()
                        raise
                # readers hold the handle; its files go with the last of them
                handle = Snapshot(new.nodes, new.edges, new.repository, new.commit_sha, new.held)
                weakref.finalize(handle, new.release)
                self._current, self._until = handle, self._clock() + self._ttl
            return self._current

    @contextmanager
    def reading(self) -> Iterator[Snapshot]:
        yield self.acquire()
