"""Differences of two graphs by id, by node key, or by identity rules."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from latticework.errors import UsageError
from latticework.functions import values as V
from latticework.functions.checkpoints import cut
from latticework.operators.graph import PropertyGraph
from latticework.operators.merge import rule_identity


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def loose_props(column: str = "props") -> Column:
    """Comparable text of a map under loose equality; a null value counts as present."""
    return V.props_key(column, V.loose_key)


def full_diff(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """``by``, change (added, removed or changed) from two (by, content) tables of unique keys."""
    both = left.select(by, F.col("content").alias("lc"), F.lit(True).alias("l")).join(right.select(by, F.col("content").alias("rc"), F.lit(True).alias("r")), by, "full_outer")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(~_same(F.col("lc"), F.col("rc")), "changed")
    return both.select(by, change.alias("change")).filter("change is not null")


def node_content(df: DataFrame, by: Column | str) -> DataFrame:
    labels = F.to_json(F.array_sort("labels"))
    return df.select(by, F.concat(labels, F.lit("|"), loose_props()).alias("content"))


def diff_nodes_by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    return full_diff(node_content(left, "id"), node_content(right, "id"), "id")


def diff_edges_by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    content = lambda df: df.select("id", F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string"), "label").alias("ends"), loose_props().alias("p")).select("id", F.concat("ends", F.lit("|"), "p").alias("content"))
    return full_diff(content(left), content(right), "id")


def identities(df: DataFrame, node_key: list[str] | None, rules: Mapping[str, list[str]] | None) -> DataFrame:
    """id, identity; an error unless every node has one of its own.

    Identities are made by SQL first; whether that was wrong for some value is
    found in the one pass that checks them.
    """
    keys = sorted(set(node_key or [k for ks in (rules or {}).values() for k in ks]))
    risky = F.lit(False)
    for k in keys:
        risky = risky | F.coalesce(V.needs_python(V.prop(k)), F.lit(False))
    for python in (False, True):
        also = (F.lit(False) if python else risky).alias("risky")
        if node_key:
            found = cut(df.select("id", V.identity_key(df, node_key, python=python).alias("identity"), F.lit(1).alias("rules"), also))
        else:
            found = cut(rule_identity(df, rules or {}, python, also))
        each = found.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("rules") - 1)).alias("off"), F.max("risky").alias("risky"))
        known = F.col("identity").isNotNull()
        facts = each.agg(F.max(F.when(known, F.col("n"))).alias("most"), F.max((~known)).alias("lost"), F.max("off").alias("off"), F.max("risky").alias("risky")).first()
        if not facts["risky"]:
            break
    if facts["off"]:
        raise UsageError("every node needs exactly one identity rule")
    if facts["lost"]:
        raise UsageError("a node has no value for its identity")
    if (facts["most"] or 0) > 1:
        raise UsageError("an identity is not unique")
    return found.select("id", "identity")


def diff_nodes_by_identity(left: DataFrame, right: DataFrame, of_left: DataFrame, of_right: DataFrame) -> DataFrame:
    content = lambda df, ids: node_content(df.join(ids, "id"), "identity")
    return full_diff(content(left, of_left), content(right, of_right), "identity")


def props_text(df: DataFrame, props: str = "props") -> Column:
    """``{k=repr, ...}`` of a map by sorted keys."""
    entries = F.array_sort(F.map_entries(props))
    risky = df.filter(F.exists(F.map_values(props), lambda x: V.needs_python(x))).limit(1)
    if risky.isEmpty():
        return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), V.text_key(e["value"], python=False))), ",")
    of = lambda get: F.transform(entries, get)
    return _props_text(of(lambda e: e["key"]), of(lambda e: e["value"]["t"]), of(lambda e: e["value"]["v"]))


@F.pandas_udf(StringType())
def _props_text(keys: pd.Series, kinds: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([",".join(f"{k}={V.python_text(t, v)}" for k, t, v in zip(*row, strict=True)) for row in zip(keys, kinds, texts, strict=True)], dtype=object)


def edge_strings(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edge: ``from -[LABEL props]-> to`` with the ends' identities; rows repeat as edges do."""
    a, b = ids.select(F.col("id").alias("src"), F.col("identity").alias("a")), ids.select(F.col("id").alias("dst"), F.col("identity").alias("b"))
    text = props_text(edges)
    named = edges.withColumn("__p", text).join(a, "src").join(b, "dst")
    inner = F.when(F.col("__p") == "", F.col("label")).otherwise(F.concat("label", F.lit(" "), "__p"))
    return named.select(F.concat("a", F.lit(" -["), inner, F.lit("]-> "), "b").alias("edge"))


def edge_multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """edge, change, n: strings that one side has more often, and how much more."""
    counted = lambda df, c: df.groupBy("edge").agg(F.count(F.lit(1)).alias(c))
    both = counted(left, "l").join(counted(right, "r"), "edge", "full_outer").select("edge", (F.coalesce("r", F.lit(0)) - F.coalesce("l", F.lit(0))).alias("d"))
    return both.filter("d != 0").select("edge", F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"), F.abs("d").alias("n"))


def changes(left: PropertyGraph, right: PropertyGraph, node_key: list[str] | None = None, rules: Mapping[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(name, change) of the nodes and of the edges that differ, for graphs of any size; in keyed modes edges never count as changed."""
    if node_key and rules:
        raise UsageError("node key and identity rules exclude each other")
    if node_key or rules:
        ids = [identities(g.nodes, node_key, rules) for g in (left, right)]
        nodes = diff_nodes_by_identity(left.nodes, right.nodes, *ids).withColumnRenamed("identity", "name")
        rows = edge_multiset_diff(*(edge_strings(g.edges, i) for g, i in zip((left, right), ids, strict=True)))
        edges = rows.select(F.col("edge").alias("name"), "change", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("one")).drop("one")
    else:
        nodes = diff_nodes_by_id(left.nodes, right.nodes).withColumnRenamed("id", "name")
        edges = diff_edges_by_id(left.edges, right.edges).withColumnRenamed("id", "name")
    return nodes, edges


def diff(left: PropertyGraph, right: PropertyGraph, node_key: list[str] | None = None, rules: Mapping[str, list[str]] | None = None) -> dict:
    """changes() as one report with the counts of both sides, for differences that fit on the driver."""
    nodes, edges = changes(left, right, node_key, rules)
    out = {}
    for kind, df in (("nodes", nodes), ("edges", edges)):
        rows = df.collect()
        out[kind] = {c: sorted(r["name"] for r in rows if r["change"] == c) for c in ("added", "removed", "changed")}
    out["left"] = {"node_count": left.node_count(), "edge_count": left.edge_count()}
    out["right"] = {"node_count": right.node_count(), "edge_count": right.edge_count()}
    out["changed"] = any(v for kind in ("nodes", "edges") for v in out[kind].values())
    return out


def format_text(report: dict) -> str:
    lines = []
    for kind in ("nodes", "edges"):
        r = report[kind]
        lines.append(f"{kind.capitalize()}: +{len(r['added'])} -{len(r['removed'])} ~{len(r['changed'])}")
        lines += [f"  {sign} {name}" for change, sign in (("added", "+"), ("removed", "-"), ("changed", "~")) for name in r[change]]
    return "\n".join(lines)
