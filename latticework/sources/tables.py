"""Graphs over star-schema tables.

A node's id is ``kind * 10**10 + key + 1``, an edge's ``kind * 10**14 + key``;
line items, which have no short key, are numbered within their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import values as V
from latticework.operators.events import event_name
from latticework.operators.graph import PropertyGraph

KINDS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6}
NODE_STEP, EDGE_STEP = 10**10, 10**14


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str | Column) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.lit(KINDS[kind] * NODE_STEP + 1).cast("long") + c.cast("long")


def _nodes(df: DataFrame, kind: str, key: str, labels: list[str], props: dict[str, tuple[str, Column]]) -> DataFrame:
    return df.select(node_id(kind, key).alias("id"), F.array(*map(F.lit, labels)).alias("labels"), V.typed_props(props).alias("props"))


def commerce_nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(KINDS), only: Column | None = None) -> DataFrame:
    """Nodes of the kinds; ``only`` filters the tables' own columns."""
    c, t = F.col, lambda n: read(spark, sf_dir, n) if only is None else read(spark, sf_dir, n).filter(only)
    made = {
        "Region": lambda: _nodes(t("region"), "Region", "r_regionkey", ["Region"], {"name": ("str", c("r_name"))}),
        "Nation": lambda: _nodes(t("nation"), "Nation", "n_nationkey", ["Nation"], {"name": ("str", c("n_name"))}),
        "Customer": lambda: _nodes(t("customer"), "Customer", "c_custkey", ["Party", "Customer"], {"name": ("str", c("c_name")), "acctbal": ("float", c("c_acctbal")), "segment": ("str", c("c_mktsegment"))}),
        "Supplier": lambda: _nodes(t("supplier"), "Supplier", "s_suppkey", ["Party", "Supplier"], {"name": ("str", c("s_name")), "acctbal": ("float", c("s_acctbal"))}),
        "Part": lambda: _nodes(t("part"), "Part", "p_partkey", ["Part"], {"name": ("str", c("p_name")), "brand": ("str", c("p_brand")), "size": ("int", c("p_size")), "retailprice": ("float", c("p_retailprice"))}),
        "Order": lambda: _nodes(t("orders"), "Order", "o_orderkey", ["Order"], {"status": ("str", c("o_orderstatus")), "totalprice": ("float", c("o_totalprice")), "priority": ("str", c("o_orderpriority"))}),
    }
    out = None
    for k in kinds:
        out = made[k]() if out is None else out.unionByName(made[k]())
    return out


#: Table and key column of each kind of node.
KEYS = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}


def commerce_node(spark: SparkSession, sf_dir: str, node: int) -> DataFrame:
    """The node of one id: its kind names the table, and its key is filtered in the scan."""
    kind = next((k for k, n in KINDS.items() if n == (node - 1) // NODE_STEP), None)
    if kind is None:
        return commerce_nodes(spark, sf_dir, ("Region",)).limit(0)
    key = (node - 1) % NODE_STEP
    return commerce_nodes(spark, sf_dir, (kind,), only=F.col(KEYS[kind][1]) == key)


def _edges(df: DataFrame, kind: int, key: Column, src: Column, dst: Column, label: str, props: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    made = V.typed_props(props) if props else F.create_map().cast(V.PROPS_TYPE)
    return df.select((F.lit(kind * EDGE_STEP).cast("long") + key.cast("long")).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), made.alias("props"))


def line_numbers(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """Line items numbered within their orders; ``only`` may filter by l_orderkey, which the numbers hang on."""
    items = read(spark, sf_dir, "lineitem")
    items = items if only is None else items.filter(only)
    order = Window.partitionBy("l_orderkey").orderBy(*[x for x in items.columns if x != "l_orderkey"])
    return items.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_orderkey") * 10_000 + F.row_number().over(order)).alias("line"))


def _line_edges(lines: DataFrame) -> DataFrame:
    """CONTAINS and SUPPLIED_BY edges of numbered line items."""
    c, n = F.col, node_id
    empty = F.create_map().cast(V.PROPS_TYPE)
    edge = lambda kind, src, dst, label, props: F.struct((F.lit(kind * EDGE_STEP).cast("long") + c("line")).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), props.alias("props"))
    both = F.array(
        edge(5, n("Order", "l_orderkey"), n("Part", "l_partkey"), "CONTAINS", V.typed_props({"quantity": ("float", c("l_quantity"))}).cast(V.PROPS_TYPE)),
        edge(6, n("Part", "l_partkey"), n("Supplier", "l_suppkey"), "SUPPLIED_BY", empty),
    )
    return lines.select(F.explode(both).alias("e")).select("e.*")


def commerce_edge(spark: SparkSession, sf_dir: str, edge: int) -> DataFrame:
    """The edge of one id: its kind names the table, and its key (of a line, its order's) is filtered in the scan."""
    kind, key = divmod(edge, EDGE_STEP)
    c, t, n = F.col, lambda x, k: read(spark, sf_dir, x).filter(F.col(k) == key), node_id
    made = {
        1: lambda: _edges(t("nation", "n_nationkey"), 1, c("n_nationkey"), n("Nation", "n_nationkey"), n("Region", "n_regionkey"), "PART_OF"),
        2: lambda: _edges(t("customer", "c_custkey"), 2, c("c_custkey"), n("Customer", "c_custkey"), n("Nation", "c_nationkey"), "IN_NATION"),
        3: lambda: _edges(t("supplier", "s_suppkey"), 3, c("s_suppkey"), n("Supplier", "s_suppkey"), n("Nation", "s_nationkey"), "IN_NATION"),
        4: lambda: _edges(t("orders", "o_orderkey"), 4, c("o_orderkey"), n("Customer", "o_custkey"), n("Order", "o_orderkey"), "PLACED"),
    }
    if kind in made:
        return made[kind]()
    return _line_edges(line_numbers(spark, sf_dir, F.col("l_orderkey") == key // 10_000)).filter(F.col("id") == edge)


def commerce_around(spark: SparkSession, sf_dir: str, node: int) -> PropertyGraph:
    """A node and the edges that touch it, each filtered by a key column of its table; the graph's nodes are just this one."""
    kind = next((k for k, number in KINDS.items() if number == (node - 1) // NODE_STEP), None)
    key = (node - 1) % NODE_STEP
    c, t, n = F.col, lambda x, k: read(spark, sf_dir, x).filter(F.col(k) == key), node_id
    nations = lambda by: _edges(t("nation", by), 1, c("n_nationkey"), n("Nation", "n_nationkey"), n("Region", "n_regionkey"), "PART_OF")
    customers = lambda by: _edges(t("customer", by), 2, c("c_custkey"), n("Customer", "c_custkey"), n("Nation", "c_nationkey"), "IN_NATION")
    suppliers = lambda by: _edges(t("supplier", by), 3, c("s_suppkey"), n("Supplier", "s_suppkey"), n("Nation", "s_nationkey"), "IN_NATION")
    placed = lambda by: _edges(t("orders", by), 4, c("o_orderkey"), n("Customer", "o_custkey"), n("Order", "o_orderkey"), "PLACED")

    def lines(by: str) -> DataFrame:
        """Lines of the orders that have one with the key: numbers need whole orders."""
        orders = t("lineitem", by).select("l_orderkey").distinct()
        items = read(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "left_semi")
        order = Window.partitionBy("l_orderkey").orderBy(*[x for x in items.columns if x != "l_orderkey"])
        return _line_edges(items.withColumn("line", F.col("l_orderkey") * 10_000 + F.row_number().over(order)))

    made = {
        "Region": lambda: [nations("n_regionkey")],
        "Nation": lambda: [nations("n_nationkey"), customers("c_nationkey"), suppliers("s_nationkey")],
        "Customer": lambda: [customers("c_custkey"), placed("o_custkey")],
        "Supplier": lambda: [suppliers("s_suppkey"), lines("l_suppkey")],
        "Part": lambda: [lines("l_partkey")],
        "Order": lambda: [placed("o_orderkey"), _line_edges(line_numbers(spark, sf_dir, F.col("l_orderkey") == key))],
    }
    parts = made[kind]() if kind else [commerce_edges(spark, sf_dir, ("PART_OF",)).limit(0)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    touching = out.filter((F.col("src") == node) | (F.col("dst") == node))
    return PropertyGraph(commerce_node(spark, sf_dir, node), touching)


def commerce_edges(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = ("PART_OF", "IN_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY")) -> DataFrame:
    c, t, n = F.col, lambda x: read(spark, sf_dir, x), node_id
    if {"CONTAINS", "SUPPLIED_BY"} <= set(labels):  # one numbering serves both
        others = tuple(x for x in labels if x not in ("CONTAINS", "SUPPLIED_BY"))
        lines = _line_edges(line_numbers(spark, sf_dir))
        return commerce_edges(spark, sf_dir, others).unionByName(lines) if others else lines
    made = {
        "PART_OF": lambda: [_edges(t("nation"), 1, c("n_nationkey"), n("Nation", "n_nationkey"), n("Region", "n_regionkey"), "PART_OF")],
        "IN_NATION": lambda: [
            _edges(t("customer"), 2, c("c_custkey"), n("Customer", "c_custkey"), n("Nation", "c_nationkey"), "IN_NATION"),
            _edges(t("supplier"), 3, c("s_suppkey"), n("Supplier", "s_suppkey"), n("Nation", "s_nationkey"), "IN_NATION"),
        ],
        "PLACED": lambda: [_edges(t("orders"), 4, c("o_orderkey"), n("Customer", "o_custkey"), n("Order", "o_orderkey"), "PLACED")],
        "CONTAINS": lambda: [_edges(line_numbers(spark, sf_dir), 5, c("line"), n("Order", "l_orderkey"), n("Part", "l_partkey"), "CONTAINS", {"quantity": ("float", c("l_quantity"))})],
        "SUPPLIED_BY": lambda: [_edges(line_numbers(spark, sf_dir), 6, c("line"), n("Part", "l_partkey"), n("Supplier", "l_suppkey"), "SUPPLIED_BY")],
    }
    out = None
    for label in labels:
        for df in made[label]():
            out = df if out is None else out.unionByName(df)
    return out


def commerce_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of every edge, repeated ones too; without edge ids no line item has to be numbered."""
    ends = [commerce_edges(spark, sf_dir, (label,)).select("src", "dst") for label in ("PART_OF", "IN_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY")]
    return reduce(DataFrame.union, ends)


def commerce(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(commerce_nodes(spark, sf_dir), commerce_edges(spark, sf_dir))


PARTY_KINDS = ("Nation", "Customer", "Supplier")


def party_left(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations and the parties in them."""
    return PropertyGraph(commerce_nodes(spark, sf_dir, PARTY_KINDS), commerce_edges(spark, sf_dir, ("IN_NATION",)))


def party_right(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The left graph changed by rule: parties with key % 7 = 3 gone, key % 11 = 5 with another balance and a flag, key % 13 = 1 also as a copy."""
    left = party_left(spark, sf_dir)
    key = (F.col("id") - 1) % NODE_STEP
    party = F.array_contains("labels", "Party")
    kept = left.nodes.filter(~(party & (key % 7 == 3)))
    extra = F.create_map(F.lit("acctbal"), V.tagged("float", V.prop_float("acctbal") + 1), F.lit("flag"), V.value_lit("changed"))
    changed = kept.withColumn("props", F.when(party & (key % 11 == 5), V.overlay(F.col("props"), extra)).otherwise(F.col("props")))
    renamed = F.create_map(F.lit("name"), V.tagged("str", F.concat(V.prop_str("name"), F.lit("-copy"))))
    copies = changed.filter(party & (key % 13 == 1)).select((F.col("id") + 5 * 10**9).alias("id"), "labels", V.overlay(F.col("props"), renamed).alias("props"))
    nodes = changed.unionByName(copies)
    source = (F.col("src") - 1) % NODE_STEP
    edges = left.edges.filter(source % 7 != 3)
    more = edges.filter(source % 13 == 1).select((F.col("id") + 5 * 10**9).alias("id"), (F.col("src") + 5 * 10**9).alias("src"), "dst", "label", "props")
    relabelled = edges.withColumn("label", F.when(source % 17 == 4, "LIVES_IN").otherwise(F.col("label")))
    return PropertyGraph(nodes, relabelled.unionByName(more))


def event_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Actors and their events: AUTHORED actor to event, NEXT from each event to the same actor's next."""
    rows = read(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    actors = rows.select("user_id").distinct().select((F.lit(10**10 + 1) + F.col("user_id")).alias("id"), F.array(F.lit("Actor")).alias("labels"), V.typed_props({"key": ("str", F.concat(F.lit("user:"), F.col("user_id").cast("string")))}).alias("props"))
    events = rows.select((F.lit(2 * 10**10 + 1) + F.col("event_id")).alias("id"), F.array(F.lit("Event")).alias("labels"), V.typed_props({"event_id": ("str", event_name(F.col("event_id"))), "operation": ("str", F.col("event_type")), "timestamp": ("str", stamp)}).alias("props"))
    empty = F.create_map().cast(V.PROPS_TYPE)
    authored = rows.select((F.lit(10**14) + F.col("event_id")).alias("id"), (F.lit(10**10 + 1) + F.col("user_id")).alias("src"), (F.lit(2 * 10**10 + 1) + F.col("event_id")).alias("dst"), F.lit("AUTHORED").alias("label"), empty.alias("props"))
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    following = rows.select("event_id", after.alias("after")).filter("after is not null").select((F.lit(2 * 10**14) + F.col("event_id")).alias("id"), (F.lit(2 * 10**10 + 1) + F.col("event_id")).alias("src"), (F.lit(2 * 10**10 + 1) + F.col("after")).alias("dst"), F.lit("NEXT").alias("label"), empty.alias("props"))
    return PropertyGraph(actors.unionByName(events), authored.unionByName(following))


def conversation_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Sessions and their turns: HAS_TURN, and NEXT from turn to turn."""
    rows = read(spark, sf_dir, "conversations")
    session, turn = F.lit(10**10 + 1) + F.col("conv_id"), F.lit(2 * 10**10 + 1) + F.col("conv_id") * 10_000 + F.col("turn")
    sessions = rows.select("conv_id").distinct().select(session.alias("id"), F.array(F.lit("Session")).alias("labels"), F.create_map().cast(V.PROPS_TYPE).alias("props"))
    turns = rows.select(turn.alias("id"), F.array(F.lit("Turn")).alias("labels"), V.typed_props({"role": ("str", F.col("role")), "text": ("str", F.col("text"))}).alias("props"))
    empty = F.create_map().cast(V.PROPS_TYPE)
    has = rows.select((F.lit(10**14) + F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), session.alias("src"), turn.alias("dst"), F.lit("HAS_TURN").alias("label"), empty.alias("props"))
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    following = rows.withColumn("after", after).filter("after is not null").select((F.lit(2 * 10**14) + F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), turn.alias("src"), (F.lit(2 * 10**10 + 1) + F.col("conv_id") * 10_000 + F.col("after")).alias("dst"), F.lit("NEXT").alias("label"), empty.alias("props"))
    return PropertyGraph(sessions.unionByName(turns), has.unionByName(following))
