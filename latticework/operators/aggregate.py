"""Degrees, histograms, top-k and grouped figures over graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degree_stats(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree of nodes with an edge; a self-loop counts on both sides."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").cast("long").alias("out_degree"), F.sum("e.i").cast("long").alias("in_degree"))


def degree_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As degree_stats, for every node."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(degree_stats(edges), "id", "left").select("id", zero("out_degree"), zero("in_degree"))


def label_histogram(nodes: DataFrame) -> DataFrame:
    """label, n: every occurrence counts."""
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def edge_label_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nodes of most edges, ties to the smaller id; without any edge the first nodes."""
    total = F.col("out_degree") + F.col("in_degree")
    if edges.limit(1).isEmpty():
        return nodes.select("id", F.lit(0).cast("long").alias("degree")).orderBy("id").limit(k)
    return degree_stats(edges).select("id", total.alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def grouped_average(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def in_degree_ranking(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("in_degree")).orderBy(F.desc("in_degree"), "id")


def degree_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """degree, n: how many nodes have each degree."""
    total = (F.col("out_degree") + F.col("in_degree")).alias("degree")
    return degree_all(nodes, edges).select(total).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def value_counts(rows: DataFrame, value: Column, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def primary_category(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """First-seen value and number of rows for each ``by``."""
    return rows.groupBy(by).agg(F.min_by(value, order).alias("primary"), F.count(F.lit(1)).alias("n"))
