"""Induced subgraphs, packs, remapping of ids, integrity, and text renderings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.errors import CorruptedGraphError
from latticework.functions import values as V
from latticework.functions.checkpoints import cut
from latticework.operators.graph import PropertyGraph, has_label, induced_edges


def numbered(df: DataFrame, order: list[str], first: int = 1, column: str = "new_id") -> DataFrame:
    """Consecutive numbers in ``order``, counted in parallel.

    Rows are sorted by range; only the partitions' sizes meet in one place, so
    no task holds all rows.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(before), "__part").withColumn(column, (place + F.col("__before") + (first - 1)).cast("long")).drop("__part", "__before")


def remapped(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids from 1 in id order; an edge without both ends is an error."""
    ids = numbered(nodes.select("id"), ["id"])
    new_nodes = nodes.join(ids, "id").select(F.col("new_id").alias("id"), "labels", "props")
    ends = edges.join(ids.select(F.col("id").alias("src"), F.col("new_id").alias("s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.col("new_id").alias("d")), "dst", "left")
    if not ends.filter("s is null or d is null").isEmpty():
        raise CorruptedGraphError("an edge refers to a node that does not exist")
    numbers = numbered(edges.select("id"), ["id"])
    new_edges = ends.join(numbers, "id").select(F.col("new_id").alias("id"), F.col("s").alias("src"), F.col("d").alias("dst"), "label", "props")
    return new_nodes, new_edges


def pack(graph: PropertyGraph, labels: Iterable[str]) -> PropertyGraph:
    """Nodes with any of the labels, the edges among them, ids from 1 in the old order."""
    wanted = sorted({x.strip() for x in labels if x.strip()})
    nodes = graph.nodes.filter(has_label(wanted) if wanted else F.lit(False))
    return PropertyGraph(*remapped(nodes, induced_edges(graph.edges, nodes.select("id"))))


def dangling(graph: PropertyGraph) -> DataFrame:
    """id and side of edges whose source or target does not exist."""
    ids = graph.nodes.select("id")
    lost = lambda end: graph.edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select("id", F.lit(end).alias("side"))
    return lost("src").union(lost("dst"))


def repair_adjacency(graph: PropertyGraph) -> dict[str, int]:
    """Check that every edge has both ends; counts of what is live."""
    if not dangling(graph).isEmpty():
        raise CorruptedGraphError("an edge refers to a node that does not exist")
    return {"nodes_rewritten": graph.node_count(), "edges_relinked": graph.edge_count()}


def display_text(props: str = "props", keys: tuple[str, ...] = ("name", "title", "path", "key")) -> Column:
    """First non-empty of the keys, else ``node:<id>``."""
    filled = [F.when(V.prop_str(k, props) != "", V.prop_str(k, props)) for k in keys]
    return F.coalesce(*filled, F.concat(F.lit("node:"), F.col("id").cast("string")))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line, section, id: a node line each, then an edge line each, below ``graph LR``."""
    title = F.coalesce(F.when(V.prop_str("name") != "", V.prop_str("name")), F.when(V.prop_str("title") != "", V.prop_str("title")), F.lit(""))
    kinds = F.when(F.size("labels") > 0, F.array_join("labels", "/")).otherwise(F.col("id").cast("string"))
    text = F.concat(kinds, F.when(title != "", F.concat(F.lit(":"), title)).otherwise(F.lit("")))
    node = F.concat(F.lit("N"), F.col("id").cast("string"), F.lit('["'), F.replace(text, F.lit('"'), F.lit("'")), F.lit('"]'))
    edge = F.concat(F.lit("N"), F.col("src").cast("string"), F.lit(" -->|"), F.col("label"), F.lit("| N"), F.col("dst").cast("string"))
    return nodes.select(F.lit(1).alias("section"), "id", node.alias("line")).union(edges.select(F.lit(2).alias("section"), "id", edge.alias("line")))


def mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    rows = mermaid_lines(nodes, edges).orderBy("section", "id").collect()
    return "\n".join(["graph LR", *(f"    {r['line']}" for r in rows)])


def viewer_summary(graph: PropertyGraph, max_nodes: int = 300, max_edges: int = 600) -> dict[str, object]:
    shown = graph.nodes.orderBy("id").limit(max_nodes)
    return {
        "labels": {r["label"]: r["n"] for r in graph.nodes.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()},
        "nodes": [(r["id"], r["text"]) for r in shown.select("id", display_text().alias("text")).collect()],
        "edges": [(r["src"], r["label"], r["dst"]) for r in induced_edges(graph.edges, shown.select("id")).orderBy("id").limit(max_edges).collect()],
    }
