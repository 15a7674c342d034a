"""Searches and views composed from the other operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import values as V
from latticework.functions.checkpoints import cut
from latticework.operators.graph import PropertyGraph
from latticework.operators.traverse import bfs_from

SEARCHED = ("text", "title", "summary", "reason", "role")


def text_search(nodes: DataFrame, words: str, keys: Iterable[str] = SEARCHED) -> DataFrame:
    """Nodes with ``words`` in any of the properties, letter case ignored."""
    hit = F.lit(False)
    for k in keys:
        hit = hit | F.coalesce(F.lower(V.prop_str(k)).contains(words.lower()), F.lit(False))
    return nodes.filter(hit)


def simple_digraph(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair of nodes, the newest."""
    newest = edges.groupBy("src", "dst").agg(F.max("id").alias("id"))
    return edges.join(newest.select("id"), "id", "left_semi")


def hop_comparison(walks: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """walk, hops, shortest, overhead for walks (walk, start, goal, hops); shortest is null beyond ``max_depth``.

    All starts are searched at once.
    """
    found = bfs_from(cut(edges.select("id", "src", "dst")), walks.select("start").distinct(), max_depth)
    least = found.select("start", F.col("id").alias("goal"), F.col("depth").alias("shortest"))
    return walks.join(least, ["start", "goal"], "left").select("walk", "hops", "shortest", (F.col("hops") - F.col("shortest")).alias("overhead"))


def bfs_tree(graph: PropertyGraph, start: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(id, depth) with the start at 0, and the edges among those nodes."""
    found = cut(bfs_from(graph.edges, graph.spark.createDataFrame([(start,)], "start long"), max_depth).select("id", "depth"))
    return found, graph.edges_between(found)


def typed_view(nodes: DataFrame, label: str, ints: Iterable[str] = (), floats: Iterable[str] = (), strings: Iterable[str] = (), bools: Iterable[str] = ()) -> DataFrame:
    """A label's nodes with native columns, for plain DataFrame work."""
    typed = [f(k).alias(k) for ks, f in ((ints, V.prop_int), (floats, V.prop_float), (strings, V.prop_str), (bools, V.prop_bool)) for k in ks]
    return nodes.filter(F.array_contains("labels", label)).select("id", *typed)


def missing_keys(nodes: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """id, label, key of nodes that lack a key their label requires."""
    out = None
    for label, keys in required.items():
        lost = F.filter(F.array(*map(F.lit, keys)), lambda k: ~F.map_contains_key("props", k))
        rows = nodes.filter(F.array_contains("labels", label)).select("id", F.lit(label).alias("label"), F.explode(lost).alias("key"))
        out = rows if out is None else out.union(rows)
    return out if out is not None else nodes.select("id", F.lit("").alias("label"), F.lit("").alias("key")).limit(0)
