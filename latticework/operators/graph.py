"""The property graph: two DataFrames, lazy queries over them, and adjacency."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from latticework.errors import NodeNotFoundError
from latticework.functions import values as V
from latticework.functions.checkpoints import ship


def has_label(labels: Iterable[str], column: str = "labels") -> Column:
    """Any of ``labels``; no labels mean no filter."""
    wanted = list(labels)
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


@dataclass(frozen=True)
class Node:
    id: int
    labels: tuple[str, ...]
    properties: dict[str, Any]

    @classmethod
    def of(cls, row: Row) -> Node:
        return cls(row["id"], tuple(row["labels"] or ()), V.decode_props(row["props"]))

    def keys(self) -> list[str]:
        return list(self.properties)

    def get(self, key: str, default: Any = None) -> Any:
        return self.properties.get(key, default)

    def __getitem__(self, key: str) -> Any:
        return self.properties[key]

    def __contains__(self, key: str) -> bool:
        return key in self.properties


@dataclass(frozen=True)
class Edge:
    id: int
    from_node: int
    to_node: int
    label: str
    properties: dict[str, Any]

    @classmethod
    def of(cls, row: Row) -> Edge:
        return cls(row["id"], row["src"], row["dst"], row["label"], V.decode_props(row["props"]))

    def keys(self) -> list[str]:
        return list(self.properties)

    def get(self, key: str, default: Any = None) -> Any:
        return self.properties.get(key, default)

    def __getitem__(self, key: str) -> Any:
        return self.properties[key]

    def __contains__(self, key: str) -> bool:
        return key in self.properties


@dataclass(frozen=True)
class Query:
    """Lazy, immutable query; every call returns a new one."""

    rows: DataFrame
    is_node: bool
    labels: tuple[str, ...] = ()
    predicate: Column | Callable[[Any], bool] | None = None
    skipped: int | None = None
    limited: int | None = None

    def label(self, name: str) -> Query:
        """Labels of several calls are alternatives."""
        return replace(self, labels=(*self.labels, name))

    def where_(self, predicate: Column | Callable[[Any], bool]) -> Query:
        """A Column (pushed down) or a Python callback on the record; a later call replaces an earlier one."""
        return replace(self, predicate=predicate)

    def skip(self, n: int) -> Query:
        return replace(self, skipped=n)

    def limit(self, n: int) -> Query:
        return replace(self, limited=n)

    def filtered(self) -> DataFrame:
        df = self.rows
        if self.labels:
            df = df.filter(has_label(self.labels) if self.is_node else F.col("label").isin(*self.labels))
        if isinstance(self.predicate, Column):
            df = df.filter(self.predicate)
        elif self.predicate is not None:
            test, of = self.predicate, Node.of if self.is_node else Edge.of
            names = df.columns
            ship(df.sparkSession)  # the callback may name this package on the executors
            df = df.filter(F.udf(lambda *xs: bool(test(of(dict(zip(names, xs, strict=True))))), "boolean")(*names))
        return df

    def dataframe(self) -> DataFrame:
        df = self.filtered().orderBy("id")
        if self.skipped:
            df = df.offset(self.skipped)
        return df if self.limited is None else df.limit(self.limited)

    def fetch(self) -> list[Node] | list[Edge]:
        return list(map(Node.of if self.is_node else Edge.of, self.dataframe().collect()))

    def count(self) -> int:
        """Rows after skip and limit."""
        n = self.filtered().count()
        n = max(0, n - (self.skipped or 0))
        return n if self.limited is None else min(n, self.limited)

    def exists(self) -> bool:
        """Skip is honoured; only as many rows as needed are looked at."""
        return len(self.filtered().select("id").limit((self.skipped or 0) + 1).collect()) > (self.skipped or 0)


class PropertyGraph:
    """A directed property multigraph.

    ``nodes``: id, labels, props.  ``edges``: id, src, dst, label, props.  Ids
    are assigned from 1 and never reused; 0 means none.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, next_node: int | None = None, next_edge: int | None = None):
        self.nodes, self.edges = nodes, edges
        self._next = {"node": next_node, "edge": next_edge}

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], V.NODE_SCHEMA), spark.createDataFrame([], V.EDGE_SCHEMA), 1, 1)

    @classmethod
    def of(cls, spark: SparkSession, nodes: Iterable[tuple], edges: Iterable[tuple] = ()) -> PropertyGraph:
        """From (labels, props) and (src, label, dst, props); ids from 1 in the order given."""
        ns = [(i, list(labels), V.encode_props(props)) for i, (labels, props) in enumerate(nodes, 1)]
        es = [(i, s, d, label, V.encode_props(props)) for i, (s, label, d, props) in enumerate(edges, 1)]
        return cls(spark.createDataFrame(ns, V.NODE_SCHEMA), spark.createDataFrame(es, V.EDGE_SCHEMA), len(ns) + 1, len(es) + 1)

    def next_id(self, kind: str) -> int:
        if self._next[kind] is None:
            df = self.nodes if kind == "node" else self.edges
            self._next[kind] = (df.agg(F.max("id")).first()[0] or 0) + 1
        return self._next[kind]

    # scans
    def all_nodes(self) -> DataFrame:
        return self.nodes.orderBy("id")

    def all_edges(self) -> DataFrame:
        return self.edges.orderBy("id")

    def get_node(self, node: int) -> Node | None:
        row = self.nodes.filter(F.col("id") == node).first()
        return Node.of(row) if row else None

    def get_edge(self, edge: int) -> Edge | None:
        row = self.edges.filter(F.col("id") == edge).first()
        return Edge.of(row) if row else None

    def scan_nodes(self, labels: Iterable[str] = ()) -> DataFrame:
        return self.nodes.filter(has_label(labels))

    def scan_edges(self, labels: Iterable[str] = ()) -> DataFrame:
        wanted = list(labels)
        return self.edges.filter(F.col("label").isin(*wanted)) if wanted else self.edges

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def node_records(self, keys: Iterable[str]) -> DataFrame:
        """id, labels, and one text column for each property key; properties cannot shadow the meta columns."""
        return self.nodes.select("id", "labels", *[V.prop(k)["v"].alias(k if k not in ("id", "labels") else f"prop_{k}") for k in keys])

    def edge_records(self, keys: Iterable[str]) -> DataFrame:
        meta = ("id", "label", "from_node", "to_node")
        return self.edges.select("id", "label", F.col("src").alias("from_node"), F.col("dst").alias("to_node"), *[V.prop(k)["v"].alias(k if k not in meta else f"prop_{k}") for k in keys])

    def all_nodes_as_records(self) -> list[dict[str, Any]]:
        return [{"id": n.id, "labels": list(n.labels), **n.properties} for n in map(Node.of, self.all_nodes().collect())]

    def all_edges_as_records(self) -> list[dict[str, Any]]:
        return [{"id": e.id, "label": e.label, "from_node": e.from_node, "to_node": e.to_node, **e.properties} for e in map(Edge.of, self.all_edges().collect())]

    def info(self, file_size: int = 0) -> dict[str, Any]:
        return {"version": "1.0", "node_count": self.node_count(), "edge_count": self.edge_count(), "file_size": file_size}

    # queries
    def query_nodes(self) -> Query:
        return Query(self.nodes, True)

    def query_edges(self) -> Query:
        return Query(self.edges, False)

    def find_page(self, where: Mapping[str, Any], label: str | None = None, cursor: int = 0, limit: int = 20) -> dict[str, Any]:
        """Nodes whose properties equal ``where`` loosely, a page at a time; next_cursor is set while pages are full."""
        size, start = min(100, max(1, limit)), max(0, cursor)
        rows = find(self.nodes, where, label).orderBy("id").offset(start).limit(size).collect()
        return {"nodes": [Node.of(r) for r in rows], "next_cursor": start + len(rows) if len(rows) == size else None}

    def find_by_key(self, label: str, key: str) -> Node | None:
        """Lowest id with the label and the string property ``key``."""
        row = self.nodes.filter(has_label([label]) & (V.prop_str("key") == key)).orderBy("id").limit(1).first()
        return Node.of(row) if row else None

    def find_file(self, path: str) -> Node | None:
        row = self.nodes.filter(has_label(["File"]) & (V.prop_str("path") == path)).orderBy("id").limit(1).first()
        return Node.of(row) if row else None

    # adjacency
    def require(self, *ids: int) -> None:
        found = {r["id"] for r in self.nodes.filter(F.col("id").isin(*ids)).select("id").collect()}
        for i in ids:
            if i not in found:
                raise NodeNotFoundError(f"node {i} not found")

    def _labelled(self, label: str | None) -> DataFrame:
        return self.edges if label is None else self.edges.filter(F.col("label") == label)

    def out_edges(self, node: int, label: str | None = None) -> DataFrame:
        """Newest edge first."""
        self.require(node)
        return self._labelled(label).filter(F.col("src") == node).orderBy(F.desc("id"))

    def in_edges(self, node: int, label: str | None = None) -> DataFrame:
        self.require(node)
        return self._labelled(label).filter(F.col("dst") == node).orderBy(F.desc("id"))

    def neighbours(self, node: int, label: str | None = None, direction: str = "out") -> DataFrame:
        """rank and the neighbour's node: one row for each edge, but distinct nodes for ``both``."""
        self.require(node)
        return neighbours_of(self.nodes, self._labelled(label), F.col("centre") == node, direction).drop("centre").orderBy("rank")

    neighbors = neighbours

    def edges_between(self, ids: Iterable[int] | DataFrame) -> DataFrame:
        """Edges with both ends in the set, by id."""
        wanted = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        return induced_edges(self.edges, wanted).orderBy("id")

    def hydrate(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """Nodes of an id column; ids without a node drop out."""
        return ids.withColumnRenamed(column, "id").join(self.nodes, "id")


def find(nodes: DataFrame, where: Mapping[str, Any], label: str | None = None) -> DataFrame:
    df = nodes.filter(has_label([label])) if label is not None else nodes
    for k, v in where.items():
        df = df.filter(V.loose_key(V.prop(k)) == V.loose_key(V.value_lit(v)))
    return df


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    one = ids.select("id").distinct()
    return edges.join(one.withColumnRenamed("id", "src"), "src", "left_semi").join(one.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def incident(edges: DataFrame, direction: str) -> DataFrame:
    """centre, other, side, edge: every edge as seen from the chosen end or ends."""
    out = edges.select(F.col("src").alias("centre"), F.col("dst").alias("other"), F.lit(0).alias("side"), F.col("id").alias("edge"))
    into = edges.select(F.col("dst").alias("centre"), F.col("src").alias("other"), F.lit(1).alias("side"), F.col("id").alias("edge"))
    if direction == "out":
        return out
    if direction == "in":
        return into
    if direction == "both":
        return out.union(into)
    raise ValueError("direction must be 'out', 'in' or 'both'")


def neighbours_of(nodes: DataFrame, edges: DataFrame, which: Column, direction: str) -> DataFrame:
    """centre, rank, node columns: newest edge first; ``both`` keeps each node once, out-neighbours first.

    The set form: every centre at once, ranks counted per centre.
    """
    from pyspark.sql import Window

    rows = incident(edges, direction).filter(which)
    if direction == "both":
        rows = rows.groupBy("centre", "other").agg(F.min(F.struct("side", (-F.col("edge")).alias("back"))).alias("first")).select("centre", "other", F.col("first.side").alias("side"), (-F.col("first.back")).alias("edge"))
    rank = F.row_number().over(Window.partitionBy("centre").orderBy("side", F.desc("edge")))
    return rows.withColumn("rank", rank).select("centre", "rank", F.col("other").alias("id")).join(nodes, "id")
