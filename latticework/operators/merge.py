"""Merging one graph into another: identities, conflict policies, and what stands in the way."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.errors import CorruptedGraphError, MergeError
from latticework.functions import values as V
from latticework.functions.checkpoints import cut
from latticework.operators.graph import PropertyGraph
from latticework.operators.mutate import merge_edges
from latticework.operators.subgraph import numbered

CONFLICTS = ("keep_dst", "overwrite_from_src", "merge_props")
EDGES = ("append", "idempotent")


@dataclass
class MergeResult:
    graph: PropertyGraph
    node_map: DataFrame
    edge_map: DataFrame

    def report(self) -> dict[str, int]:
        count = lambda df, made: df.filter(F.col("created") == made).count()
        return {"nodes_created": count(self.node_map, True), "nodes_reused": count(self.node_map, False), "edges_created": count(self.edge_map, True), "edges_reused": count(self.edge_map, False)}


def keys_identity(df: DataFrame, keys: list[str]) -> DataFrame:
    """id, identity by strict equality on all keys; null where a key is missing or never equal."""
    parts = [V.strict_key(V.prop(k)) for k in keys]
    joined = F.concat(*[F.concat(F.length(p).cast("string"), F.lit("#"), p) for p in parts])
    return df.select("id", joined.alias("identity"), *[F.map_contains_key("props", F.lit(k)).alias(f"has_{i}") for i, k in enumerate(keys)])


def rule_identity(df: DataFrame, rules: Mapping[str, list[str]], python: bool | None = None, *also: Column) -> DataFrame:
    """id, identity, rules (how many labels have one), missing, and ``also``: ``Label:k=repr,...`` by the one rule of a node's labels."""
    if not rules:
        return df.select("id", F.lit(None).cast("string").alias("identity"), F.lit(0).alias("rules"), F.lit(False).alias("missing"), *also)
    if python is None:
        python = V.python_needed(df, [V.prop(k) for k in sorted({k for keys in rules.values() for k in keys})])
    matched = F.filter(F.array_distinct("labels"), lambda x: x.isin(*rules))
    text = F.lit(None).cast("string")
    for label, keys in rules.items():
        text = F.when(matched[0] == label, F.concat(F.lit(f"{label}:"), V.identity_key(df, keys, python=python))).otherwise(text)
    one = F.size(matched) == 1
    return df.select("id", F.when(one, text).alias("identity"), F.size(matched).alias("rules"), (one & text.isNull()).alias("missing"), *also)


def merge_from(
    dst: PropertyGraph, src: PropertyGraph, node_key: list[str] | None = None, edge_strategy: str = "append", on_node_conflict: str = "keep_dst", rules: Mapping[str, list[str]] | None = None
) -> MergeResult:
    """Merge ``src`` into ``dst`` in set form.

    With an identity, source nodes of one identity become one node: the lowest
    destination id that has it, else a new node at the place of the first.
    Properties fold the destination's layer and then the source's by id; labels
    of a reused node stay.  Edges are appended, or matched by ends, label and
    strictly equal properties.
    """
    if dst is src:
        raise ValueError("cannot merge a graph into itself")
    if edge_strategy not in EDGES:
        raise ValueError(f"unknown edge strategy {edge_strategy}")
    if on_node_conflict not in CONFLICTS:
        raise ValueError(f"unknown conflict mode {on_node_conflict}")
    if node_key is not None and not node_key:
        raise MergeError("node_key must not be empty")
    if node_key:
        ident = keys_identity(src.nodes, node_key)
        lost = F.lit(False)
        for i in range(len(node_key)):
            lost = lost | ~F.col(f"has_{i}")
        if not ident.filter(lost).isEmpty():
            raise MergeError("a source node has no value for the node key")
        of_src, of_dst = ident.select("id", "identity"), keys_identity(dst.nodes, node_key).select("id", "identity")
    elif rules:
        of_src, of_dst = (rule_identity(g.nodes, rules).select("id", "identity") for g in (src, dst))
    else:
        of_src, of_dst = src.nodes.select("id", F.lit(None).cast("string").alias("identity")), None
    own = F.coalesce("identity", F.concat(F.lit("\0"), F.col("id").cast("string")))
    of_src = cut(of_src.select(F.col("id").alias("src_id"), own.alias("identity")))
    firsts = of_src.groupBy("identity").agg(F.min("src_id").alias("first"))
    if of_dst is None:
        known = firsts.withColumn("dst_id", F.lit(None).cast("long"))
    else:
        least = of_dst.filter("identity is not null").groupBy("identity").agg(F.min("id").alias("dst_id"))
        known = firsts.join(least, "identity", "left")
    made = numbered(known.filter("dst_id is null").select("identity", "first"), ["first"], dst.next_id("node"))
    places = known.filter("dst_id is not null").select("identity", "first", F.col("dst_id").alias("dst_id"), F.lit(True).alias("old")).union(made.select("identity", "first", "new_id", F.lit(False)))
    node_map = cut(of_src.join(places, "identity").select(F.col("src_id"), "dst_id", (~F.col("old") & (F.col("src_id") == F.col("first"))).alias("created"), "old", "first"))

    layers = src.nodes.select(F.col("id").alias("src_id"), "labels", "props").join(node_map, "src_id")
    folded = fold(layers.select("dst_id", F.col("src_id").alias("place"), "props"), on_node_conflict)
    fresh = layers.filter("created").select(F.col("dst_id").alias("id"), "labels", F.col("props").alias("__first")).join(folded.withColumnRenamed("dst_id", "id"), "id", "left")
    fresh = fresh.select("id", "labels", F.col("__first").alias("props") if on_node_conflict == "keep_dst" else F.coalesce("folded", "__first").alias("props"))
    if on_node_conflict == "keep_dst":
        kept = dst.nodes
    else:
        over = dst.nodes.join(folded.withColumnRenamed("dst_id", "id"), "id", "left")
        props = V.overlay(F.col("props"), F.col("folded"), last_wins=on_node_conflict == "overwrite_from_src")
        kept = over.select("id", "labels", F.when(F.col("folded").isNull(), F.col("props")).otherwise(props).alias("props"))
    nodes = kept.unionByName(fresh)

    ends = node_map.select(F.col("src_id").alias("n"), "dst_id")
    moved = src.edges.join(ends.select(F.col("n").alias("src"), F.col("dst_id").alias("s")), "src", "left").join(ends.select(F.col("n").alias("dst"), F.col("dst_id").alias("d")), "dst", "left")
    moved = cut(moved.select("id", F.col("s").alias("src"), F.col("d").alias("dst"), "label", "props"))
    if not moved.filter("src is null or dst is null").isEmpty():
        raise CorruptedGraphError("a source edge refers to a node that does not exist")
    if edge_strategy == "append":
        new = numbered(moved, ["id"], dst.next_id("edge"))
        edges = dst.edges.unionByName(new.select(F.col("new_id").alias("id"), "src", "dst", "label", "props"))
        edge_map = new.select(F.col("id").alias("src_id"), F.col("new_id").alias("dst_id"), F.lit(True).alias("created"))
    else:
        edges, answer = merge_edges(dst.edges, moved, dst.next_id("edge"))
        edge_map = answer.select(F.col("id").alias("src_id"), F.col("edge").alias("dst_id"), "created")
    return MergeResult(PropertyGraph(nodes, edges), node_map.select("src_id", "dst_id", "created"), edge_map)


def fold(layers: DataFrame, mode: str) -> DataFrame:
    """dst_id, folded: property layers in order of place, the last (or first) value of each key; keep_dst needs only the first layer."""
    if mode == "keep_dst":
        return layers.groupBy("dst_id").agg(F.min_by("props", "place").alias("folded"))
    pick = F.max_by if mode == "overwrite_from_src" else F.min_by
    values = layers.select("dst_id", "place", F.explode("props").alias("key", "value"))
    one = values.groupBy("dst_id", "key").agg(pick("value", "place").alias("value"))
    return one.groupBy("dst_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("folded"))


def key_conflicts(dst: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """type, side, identity, ids: what keeps a merge by node key from being plain."""
    with_text = lambda df: df.select("id", V.identity_key(df, keys).alias("identity"))
    s, d = cut(with_text(src)), cut(with_text(dst))  # narrow, and read five times below
    missing = s.filter("identity is null").select(F.lit("missing_node_key").alias("type"), F.lit("source").alias("side"), F.lit(None).cast("string").alias("identity"), F.array("id").alias("ids"))
    several = lambda df: df.filter("identity is not null").groupBy("identity").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter("size(ids) > 1")
    duplicate = lambda df, side: several(df).select(F.lit("duplicate_node_key").alias("type"), F.lit(side).alias("side"), "identity", "ids")
    ambiguous = several(d).join(s.select("identity").distinct(), "identity", "left_semi").select(F.lit("ambiguous_destination_node_key").alias("type"), F.lit("destination").alias("side"), "identity", "ids")
    return missing.union(duplicate(s, "source")).union(duplicate(d, "destination")).union(ambiguous)


def rule_conflicts(dst: DataFrame, src: DataFrame, rules: Mapping[str, list[str]]) -> DataFrame:
    """type, side, identity, ids: what keeps a merge by identity rules from running."""
    out = None
    for side, df in (("source", src), ("destination", dst)):
        ident = cut(rule_identity(df, rules))
        kind = F.when((F.col("rules") == 0) & F.lit(side == "source"), "unmatched_identity_rule").when(F.col("rules") > 1, "multiple_identity_rules").when(F.col("missing"), "missing_identity_rule_key")
        single = ident.select(kind.alias("type"), F.lit(side).alias("side"), F.lit(None).cast("string").alias("identity"), F.array("id").alias("ids")).filter("type is not null")
        double = ident.filter("identity is not null").groupBy("identity").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter("size(ids) > 1")
        found = single.union(double.select(F.lit("duplicate_identity_rule").alias("type"), F.lit(side).alias("side"), "identity", "ids"))
        out = found if out is None else out.union(found)
    return out


def warnings(dst: DataFrame, src: DataFrame, pairs: DataFrame, on_node_conflict: str = "keep_dst") -> DataFrame:
    """type, src_id, dst_id, key, dst_value, src_value, resolution for matched (src_id, dst_id) pairs.

    A property conflict is a shared key with loosely different values; labels
    differ as sorted lists.
    """
    resolution = {"keep_dst": "keep_dst", "overwrite_from_src": "overwrite_from_src", "merge_props": "keep_dst"}[on_node_conflict]
    a = src.select(F.col("id").alias("src_id"), F.col("labels").alias("src_labels"), F.col("props").alias("src_props"))
    b = dst.select(F.col("id").alias("dst_id"), F.col("labels").alias("dst_labels"), F.col("props").alias("dst_props"))
    both = pairs.select("src_id", "dst_id").join(a, "src_id").join(b, "dst_id")
    shared = both.select("src_id", "dst_id", "dst_props", F.explode("src_props").alias("key", "value")).filter(F.map_contains_key("dst_props", F.col("key")))
    other = F.element_at("dst_props", F.col("key"))
    same = F.coalesce(V.loose_key(F.col("value")) == V.loose_key(other), F.lit(False))
    props = shared.filter(~same).select(F.lit("node_property_conflict").alias("type"), "src_id", "dst_id", "key", other["v"].alias("dst_value"), F.col("value.v").alias("src_value"), F.lit(resolution).alias("resolution"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    labels = both.filter(F.array_sort("src_labels") != F.array_sort("dst_labels")).select(F.lit("node_label_difference").alias("type"), "src_id", "dst_id", F.lit(None).cast("string").alias("key"), text("dst_labels").alias("dst_value"), text("src_labels").alias("src_value"), F.lit("keep_dst").alias("resolution"))
    return props.union(labels)


def preview(dst: PropertyGraph, src: PropertyGraph, node_key: list[str] | None = None, rules: Mapping[str, list[str]] | None = None, edge_strategy: str = "append", on_node_conflict: str = "keep_dst") -> dict:
    """What a merge would do, without doing it; zeros where conflicts stand in the way."""
    empty = {"nodes_created": 0, "nodes_reused": 0, "edges_created": 0, "edges_reused": 0}
    found = key_conflicts(dst.nodes, src.nodes, node_key) if node_key else rule_conflicts(dst.nodes, src.nodes, rules) if rules else None
    conflicts = [r.asDict() for r in found.orderBy("type", "side", "ids").collect()] if found is not None else []
    if conflicts:
        return {"can_merge": False, "conflicts": conflicts, "warnings": [], "report": empty}
    result = merge_from(dst, src, node_key, edge_strategy, on_node_conflict, rules)
    pairs = result.node_map.join(dst.nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    told = [r.asDict() for r in warnings(dst.nodes, src.nodes, pairs, on_node_conflict).orderBy("src_id", "type", "key").collect()] if node_key or rules else []
    return {"can_merge": True, "conflicts": [], "warnings": told, "report": result.report()}


def format_text(report: dict, shown: int = 10) -> str:
    """A preview's report in lines: counts, then conflicts and the first warnings."""
    counts = report["report"]
    lines = ["Merge preview", f"Can merge: {'yes' if report['can_merge'] else 'no'}"]
    lines += [f"Nodes: {counts['nodes_created']} created, {counts['nodes_reused']} reused", f"Edges: {counts['edges_created']} created, {counts['edges_reused']} reused"]
    lines += [f"Conflicts: {len(report['conflicts'])}"] + [f"  {c['type']} ({c['side']}): {c['identity'] or c['ids']}" for c in report["conflicts"]]
    lines += [f"Warnings: {len(report['warnings'])}"] + [f"  {w['type']} {w['src_id']} -> {w['dst_id']}: {w['key'] or 'labels'} {w['dst_value']} / {w['src_value']}" for w in report["warnings"][:shown]]
    return "\n".join(lines)
