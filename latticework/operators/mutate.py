"""Set-based writes: every function takes a graph and gives a new one."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.errors import EdgeNotFoundError, NodeNotFoundError
from latticework.functions import values as V
from latticework.operators.graph import PropertyGraph
from latticework.operators.subgraph import numbered


def add_nodes(graph: PropertyGraph, rows: Iterable[tuple[Iterable[str], Mapping[str, Any]]]) -> tuple[PropertyGraph, list[int]]:
    first = graph.next_id("node")
    made = [(first + i, list(labels), V.encode_props(props)) for i, (labels, props) in enumerate(rows)]
    if not made:
        return graph, []
    new = graph.spark.createDataFrame(made, V.NODE_SCHEMA)
    return PropertyGraph(graph.nodes.unionByName(new), graph.edges, first + len(made), graph.next_id("edge")), [m[0] for m in made]


def add_edges(graph: PropertyGraph, rows: Iterable[tuple[int, str, int, Mapping[str, Any]]]) -> tuple[PropertyGraph, list[int]]:
    """Both ends must exist; parallel edges and self-loops may."""
    first = graph.next_id("edge")
    made = [(first + i, s, d, label, V.encode_props(props)) for i, (s, label, d, props) in enumerate(rows)]
    if not made:
        return graph, []
    graph.require(*{e for m in made for e in m[1:3]})
    new = graph.spark.createDataFrame(made, V.EDGE_SCHEMA)
    return PropertyGraph(graph.nodes, graph.edges.unionByName(new), graph.next_id("node"), first + len(made)), [m[0] for m in made]


def update(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Shallow merge of (id, changed) property maps: given keys overwrite, the others stay."""
    return df.join(changes.select("id", F.col("changed").alias("__changed")), "id", "left").withColumn("props", F.when(F.col("__changed").isNull(), F.col("props")).otherwise(V.overlay(F.col("props"), F.col("__changed")))).select(*df.columns)


def update_node(graph: PropertyGraph, node: int, **props: Any) -> PropertyGraph:
    if graph.get_node(node) is None:
        raise NodeNotFoundError(f"node {node} not found")
    nodes = graph.nodes.withColumn("props", F.when(F.col("id") == node, V.overlay(F.col("props"), V.props_lit(props))).otherwise(F.col("props")))
    return PropertyGraph(nodes, graph.edges, graph.next_id("node"), graph.next_id("edge"))


def update_edge(graph: PropertyGraph, edge: int, **props: Any) -> PropertyGraph:
    if graph.get_edge(edge) is None:
        raise EdgeNotFoundError(f"edge {edge} not found")
    edges = graph.edges.withColumn("props", F.when(F.col("id") == edge, V.overlay(F.col("props"), V.props_lit(props))).otherwise(F.col("props")))
    return PropertyGraph(graph.nodes, edges, graph.next_id("node"), graph.next_id("edge"))


def delete_cascade(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``ids`` and every edge that touches one."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def delete_node(graph: PropertyGraph, node: int) -> PropertyGraph:
    graph.require(node)
    nodes, edges = delete_cascade(graph.nodes, graph.edges, graph.spark.createDataFrame([(node,)], "id long"))
    return PropertyGraph(nodes, edges, graph.next_id("node"), graph.next_id("edge"))


def delete_edge(graph: PropertyGraph, edge: int) -> PropertyGraph:
    if graph.get_edge(edge) is None:
        raise EdgeNotFoundError(f"edge {edge} not found")
    return PropertyGraph(graph.nodes, graph.edges.filter(F.col("id") != edge), graph.next_id("node"), graph.next_id("edge"))


def merge_edges(edges: DataFrame, wanted: DataFrame, next_edge: int) -> tuple[DataFrame, DataFrame]:
    """Get or create: (edges after, (id, edge, created) for each wanted row).

    ``wanted`` has id (its order), src, dst, label and props.  A match has equal
    ends, label and strictly equal properties; the newest one is taken.  Equal
    wanted rows create one edge; properties with NaN never match.
    """
    key = V.props_key("props")
    have = edges.withColumn("__key", key).filter("__key is not null").groupBy("src", "dst", "label", "__key").agg(F.max("id").alias("edge"))
    asked = wanted.withColumn("__key", F.coalesce(key, F.concat(F.lit("never "), F.col("id").cast("string"))))
    firsts = asked.groupBy("src", "dst", "label", "__key").agg(F.min("id").alias("first"), F.min_by("props", "id").alias("props"))
    known = firsts.join(have, ["src", "dst", "label", "__key"], "left")
    made = numbered(known.filter("edge is null").select("src", "dst", "label", "__key", "props", "first"), ["first"], next_edge)
    after = edges.unionByName(made.select(F.col("new_id").alias("id"), "src", "dst", "label", "props"))
    ids = known.filter("edge is not null").select("src", "dst", "label", "__key", "edge", F.lit(False).alias("created")).union(made.select("src", "dst", "label", "__key", "new_id", F.lit(True)))
    answer = asked.join(ids, ["src", "dst", "label", "__key"]).join(firsts.select("src", "dst", "label", "__key", "first"), ["src", "dst", "label", "__key"])
    return after, answer.select("id", "edge", (F.col("created") & (F.col("id") == F.col("first"))).alias("created"))


def merge_edge(graph: PropertyGraph, src: int, label: str, dst: int, **props: Any) -> tuple[PropertyGraph, int]:
    graph.require(src, dst)
    wanted = graph.spark.createDataFrame([(0, src, dst, label, V.encode_props(props))], V.EDGE_SCHEMA)
    after, answer = merge_edges(graph.edges, wanted, graph.next_id("edge"))
    row = answer.first()
    return PropertyGraph(graph.nodes, after, graph.next_id("node"), graph.next_id("edge") + int(row["created"])), row["edge"]
