"""Snapshot store: versions of a graph as Parquet, published by one atomic rename.

A folder holds ``v<N>/nodes``, ``v<N>/edges`` and the file CURRENT.  Commit
writes version N + 1 beside the others and then renames a new CURRENT over the
old one; a crash before the rename leaves version N in place.  One writer at a
time holds the file LOCK.  All of it goes through Spark's file systems, so the
folder may lie in any store that the cluster shares.
"""

from __future__ import annotations

import json
import os
import socket
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from latticework.errors import AlreadyOpenError, TransactionError
from latticework.functions import values as V
from latticework.operators import mutate, subgraph
from latticework.operators.graph import PropertyGraph
from latticework.sources.folder import Folder

MEMORY = ":memory:"
_OPEN: set[str] = set()


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


class GraphStore:
    """A graph that is read from and committed to a folder; writes are staged until commit()."""

    def __init__(self, spark: SparkSession, path: str = MEMORY):
        self.spark, self.path, self.closed = spark, path, False
        self.in_transaction = False
        self._committed: PropertyGraph
        if path == MEMORY:
            self._committed = PropertyGraph.empty(spark)
            self.version = 0
        else:
            self.folder = Folder(spark, path)
            self.path = self.folder.path
            self._lock()
            self.version = 0
            self._committed = self._load()
        self._graph = self._committed

    # lifecycle
    def _lock(self) -> None:
        if self.path in _OPEN:
            raise AlreadyOpenError(f"{self.path} is open already")
        self.folder.make()
        for _ in range(2):
            if self.folder.write("LOCK", f"{socket.gethostname()} {os.getpid()}", overwrite=False):
                break
            host, _, pid = self.folder.read("LOCK").partition(" ")
            if host != socket.gethostname() or (pid.isdigit() and _alive(int(pid))):
                raise AlreadyOpenError(f"{self.path} is open in process {pid} on {host}")
            self.folder.delete("LOCK")  # left by a process that is gone
        else:
            raise AlreadyOpenError(f"{self.path} was opened by another process")
        _OPEN.add(self.path)

    def close(self) -> None:
        """Uncommitted work is lost; closing twice is fine."""
        if not self.closed and self.path != MEMORY:
            self.folder.delete("LOCK")
            _OPEN.discard(self.path)
        self.closed = True

    def __enter__(self) -> GraphStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _load(self) -> PropertyGraph:
        if not self.folder.exists("CURRENT"):
            return PropertyGraph.empty(self.spark)
        meta = json.loads(self.folder.read("CURRENT"))
        self.version = meta["version"]
        folder = f"{self.path}/v{self.version}"
        nodes = self.spark.read.schema(V.NODE_SCHEMA).parquet(f"{folder}/nodes")
        edges = self.spark.read.schema(V.EDGE_SCHEMA).parquet(f"{folder}/edges")
        return PropertyGraph(nodes, edges, meta["next_node"], meta["next_edge"])

    @property
    def graph(self) -> PropertyGraph:
        if self.closed:
            raise ValueError("the graph is closed")
        return self._graph

    @graph.setter
    def graph(self, value: PropertyGraph) -> None:
        if self.closed:
            raise ValueError("the graph is closed")
        self._graph = value

    # durability
    def _publish(self, graph: PropertyGraph) -> None:
        if self.path != MEMORY:
            version = self.version + 1
            folder = f"{self.path}/v{version}"
            self.folder.delete(f"v{version}")
            graph.nodes.write.parquet(f"{folder}/nodes")
            graph.edges.write.parquet(f"{folder}/edges")
            meta = {"version": version, "next_node": graph.next_id("node"), "next_edge": graph.next_id("edge")}
            temporary = f"CURRENT.{uuid.uuid4().hex}"
            self.folder.write(temporary, json.dumps(meta))
            self.folder.replace(temporary, "CURRENT")
            self.version = version
            graph = self._load()
        self._committed = self._graph = graph

    def commit(self) -> None:
        self.in_transaction = False
        self._publish(self.graph)

    def rollback(self) -> None:
        """Drop what is staged; ids go back to those of the last commit."""
        self.in_transaction = False
        self.graph = self._committed

    def begin(self) -> None:
        """Writes are always staged; nothing to do."""

    @contextmanager
    def transaction(self) -> Iterator[GraphStore]:
        if self.in_transaction:
            raise TransactionError("transactions do not nest")
        self.in_transaction = True
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    def clear(self) -> None:
        """Empty the graph at once; ids start from 1, and this cannot be rolled back."""
        self._publish(PropertyGraph.empty(self.spark))

    def vacuum(self) -> None:
        """Commit what is staged, write it anew in compact form and remove older versions; ids and their counters stay."""
        if self.in_transaction:
            raise TransactionError("vacuum inside a transaction")
        self._publish(self.graph)
        if self.path != MEMORY:
            for name in self.folder.names():
                if name.startswith("v") and name != f"v{self.version}":
                    self.folder.delete(name)

    def repair_adjacency(self) -> dict[str, int]:
        counts = subgraph.repair_adjacency(self.graph)
        self.commit()
        return counts

    def file_size(self) -> int:
        return 0 if self.path == MEMORY else self.folder.size(f"v{self.version}")

    def info(self) -> dict:
        return self.graph.info(self.file_size())

    # staged writes
    def add_node(self, labels: list[str], **props: object) -> int:
        self.graph, ids = mutate.add_nodes(self.graph, [(labels, props)])
        return ids[0]

    def add_edge(self, src: int, label: str, dst: int, **props: object) -> int:
        self.graph, ids = mutate.add_edges(self.graph, [(src, label, dst, props)])
        return ids[0]

    def update_node(self, node: int, **props: object) -> None:
        self.graph = mutate.update_node(self.graph, node, **props)

    def update_edge(self, edge: int, **props: object) -> None:
        self.graph = mutate.update_edge(self.graph, edge, **props)

    def delete_node(self, node: int) -> None:
        self.graph = mutate.delete_node(self.graph, node)

    def delete_edge(self, edge: int) -> None:
        self.graph = mutate.delete_edge(self.graph, edge)

    def merge_edge(self, src: int, label: str, dst: int, **props: object) -> int:
        self.graph, edge = mutate.merge_edge(self.graph, src, label, dst, **props)
        return edge
