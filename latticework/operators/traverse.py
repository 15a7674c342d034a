"""Breadth-first and depth-first traversal, shortest paths, PageRank, and short cycles.

A frontier advances by one join with the edges a round.  Candidates of a round
are ordered by (rank of the parent, edge id descending) and the first for each
target stays, which is the order in which a queue would discover them.  Rounds
are cut off with a checkpoint; hop counts, not data sizes, set their number.
A frontier of many rows is numbered by range, so that no task sorts all of it.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.functions.checkpoints import cut, let_go, remove, scratch
from latticework.operators.graph import PropertyGraph
from latticework.operators.subgraph import numbered

#: Rows of a frontier that a window may number; a larger one is numbered by range.
WINDOW_ROWS = 200_000
#: Rounds of PageRank whose layers are kept, each a table of the nodes that it reaches.
LAYERS = 8


def advance(edges: DataFrame, frontier: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """Nodes first reached at ``depth`` from (start, id, rank) rows; ``at`` and ``back`` give their order."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("id").alias("edge")).join(frontier.select("start", "id", "rank"), "id")
    first = step.groupBy("start", "to").agg(F.min(F.struct("rank", (-F.col("edge")).alias("back"), F.col("id").alias("parent"))).alias("f"))
    new = first.join(seen.select("start", F.col("id").alias("to")), ["start", "to"], "left_anti")
    return new.select("start", F.col("to").alias("id"), F.lit(depth).cast("int").alias("depth"), F.col("f.rank").alias("at"), F.col("f.back").alias("back"), F.col("f.parent").alias("parent"))


def placed(new: DataFrame) -> tuple[DataFrame, int]:
    """start, id, depth, rank, parent of a cut-off round, and its number of rows; ranks rise within each start."""
    n = new.count()
    if n > WINDOW_ROWS:
        ranked_ = numbered(new, ["start", "at", "back"], column="rank")
    else:
        ranked_ = new.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("at", "back")).cast("long"))
    return ranked_.select("start", "id", "depth", "rank", "parent"), n


def bfs_from(edges: DataFrame, starts: DataFrame, max_depth: int, goal: int | None = None) -> DataFrame:
    """start, id, depth, rank (rising within start and depth), parent; the starts themselves have depth 0.

    ``starts`` has one column, start.  With ``goal``, rounds end once it is
    found.  The edges are kept on the executors while rounds read them, with
    their lineage, and let go at the end.
    """
    edges = edges.select("id", "src", "dst")
    if max_depth > 1:
        edges = edges.persist()
    try:
        seen = cut(starts.select("start", F.col("start").alias("id"), F.lit(0).cast("int").alias("depth"), F.lit(1).cast("long").alias("rank"), F.lit(None).cast("long").alias("parent")))
        frontier = seen
        for depth in range(1, max_depth + 1):
            frontier, n = placed(cut(advance(edges, frontier, seen, depth)))
            if not n:
                break
            seen = seen.union(frontier)
            if goal is not None and not frontier.filter(F.col("id") == goal).isEmpty():
                break
    finally:
        if max_depth > 1:
            edges.unpersist()
    return seen


def ranked(found: DataFrame) -> DataFrame:
    """One running rank for each start in order of discovery, 0 for the start itself.

    Ranks of one start and depth are consecutive already, so only their least
    and their number are summed up.
    """
    sizes = found.groupBy("start", "depth").agg(F.min("rank").alias("__least"), F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy("start").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("start", "depth", (ahead - F.col("__least")).alias("__shift"))
    return found.join(before, ["start", "depth"]).withColumn("rank", F.col("rank") + F.col("__shift")).select(*found.columns)


def bfs(graph: PropertyGraph, start: int, max_depth: int) -> DataFrame:
    """rank, id, depth in order of discovery, without the start; follows out-edges of every label."""
    if max_depth > 0:
        graph.require(start)
    starts = graph.spark.createDataFrame([(start,)], "start long")
    return ranked(bfs_from(graph.edges, starts, max_depth)).filter("depth > 0").select(F.col("rank").cast("long").alias("rank"), "id", "depth").orderBy("rank")


def dfs(graph: PropertyGraph, start: int, max_depth: int) -> DataFrame:
    """rank, id, depth of a depth-first walk that marks nodes when they are put on the stack.

    The walk is sequential by nature; it runs in one task over the part of the
    graph within ``max_depth`` hops, which is found breadth first.
    """
    if max_depth <= 0:
        return graph.spark.createDataFrame([], "rank long, id long, depth int")
    graph.require(start)
    starts = graph.spark.createDataFrame([(start,)], "start long")
    near = bfs_from(graph.edges, starts, max_depth).select("id")
    part = graph.edges.select("id", "src", "dst").join(near.withColumnRenamed("id", "src"), "src", "left_semi")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        for s, d in zip(rows.sort_values("id", ascending=False)["src"], rows.sort_values("id", ascending=False)["dst"], strict=True):
            out.setdefault(int(s), []).append(int(d))
        seen, stack, found = {start}, [(start, 0)], []
        while stack:
            node, depth = stack.pop()
            if node != start:
                found.append((len(found) + 1, node, depth))
            if depth < max_depth:
                for to in out.get(node, []):
                    if to not in seen:
                        seen.add(to)
                        stack.append((to, depth + 1))
        return pd.DataFrame(found, columns=["rank", "id", "depth"])

    return part.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(walk, "rank long, id long, depth int").orderBy("rank")


def shortest_path(graph: PropertyGraph, start: int, goal: int, label: str | None = None, max_hops: int = 10_000) -> DataFrame | None:
    """pos, id of the path, both ends included; None if there is none.  A missing goal is not an error, a missing start is."""
    if graph.get_node(start) is None:
        if start == goal:
            return None
        graph.require(start)
    if start == goal:
        return graph.spark.createDataFrame([(0, start)], "pos int, id long")
    edges = graph.edges if label is None else graph.edges.filter(F.col("label") == label)
    found = bfs_from(edges, graph.spark.createDataFrame([(start,)], "start long"), max_hops, goal)
    end = found.filter(F.col("id") == goal).select("depth").first()
    if end is None:
        return None
    path, at = [goal], goal
    for depth in range(end["depth"], 0, -1):
        at = found.filter((F.col("depth") == depth) & (F.col("id") == at)).select("parent").first()["parent"]
        path.append(at)
    return graph.spark.createDataFrame(list(enumerate(reversed(path))), "pos int, id long").orderBy("pos")


def labelled(edges: DataFrame, hops: DataFrame, label: str | None = None) -> DataFrame:
    """The hops (src, dst and any other columns) with the label of the newest edge of each."""
    kept = edges if label is None else edges.filter(F.col("label") == label)
    named = hops.join(kept.select("src", "dst", "label", F.col("id").alias("edge")), ["src", "dst"])
    return named.groupBy(*hops.columns).agg(F.max_by("label", "edge").alias("label"))


def hop_labels(edges: DataFrame, path: DataFrame, label: str | None = None) -> DataFrame:
    """pos, src, dst, label: for each hop of a (pos, id) path the label of its newest edge."""
    hops = path.select(F.col("pos"), F.col("id").alias("src")).join(path.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("dst")), "pos")
    return labelled(edges, hops.select("pos", "src", "dst"), label)


def branches(graph: PropertyGraph, node: int) -> DataFrame:
    """label, to_node, labels, props: all out-edges of a node by (label, target)."""
    out = graph.edges.filter(F.col("src") == node).select("label", F.col("dst").alias("to_node"))
    return out.join(graph.nodes.select(F.col("id").alias("to_node"), "labels", "props"), "to_node").orderBy("label", "to_node")


def depth_histogram(graph: PropertyGraph, starts: DataFrame, max_depth: int) -> DataFrame:
    """start, depth, n for each depth reached."""
    return bfs_from(graph.edges, starts, max_depth).filter("depth > 0").groupBy("start", "depth").agg(F.count(F.lit(1)).alias("n"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 50, alpha: float = 0.85) -> DataFrame:
    """id, rank: parallel edges collapsed, the mass of nodes without out-edges spread evenly.

    The ranks of round t are the sum over k of fresh[t - k] * layer k: layer k
    is what an even start sends along walks of k links, fresh[t] is what round
    t gives to all nodes alike.  Where walks end, as they do without cycles,
    layers run out and so do rounds over the links; else, after ``LAYERS``
    rounds, the ranks themselves go on round by round.  Links stay where their
    source's hash puts them, and a round's files are removed after it.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = edges.select("src", "dst").repartition(parts, "src").distinct().sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY)
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    base = nodes.select("id").repartition(parts, "id").join(degree, "id", "left").sortWithinPartitions("id").persist(StorageLevel.DISK_ONLY)

    def sent(mass: DataFrame) -> DataFrame:
        share = mass.select(F.col("id").alias("src"), (F.col("rank") / F.col("n")).alias("share"))
        return links.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("g"))

    def kept(rows: DataFrame) -> tuple[str, DataFrame]:
        path = scratch(spark, "ranks")
        rows.write.parquet(path)
        let_go(spark)
        return path, spark.read.schema(rows.schema).parquet(path)

    def dangling(mass: DataFrame) -> float:
        return mass.filter("n is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]

    layers, lost, ended = [base.select("id", "n", F.lit(1.0 / n).alias("rank"))], [], False
    while not ended and len(lost) < min(iterations, LAYERS):
        lost.append(dangling(layers[-1]))
        _, following = kept(sent(layers[-1]).join(base, "id").select("id", "n", (alpha * F.col("g")).alias("rank")))
        ended = following.isEmpty()
        layers += [] if ended else [following]
    rounds = iterations if ended else len(lost)
    fresh = [1.0]
    for t in range(rounds):
        fresh.append(1 - alpha + alpha * sum(x * fresh[t - j] for j, x in enumerate(lost[: t + 1])))
    ranks = nodes.select("id", F.lit(fresh[rounds] / n).alias("rank"))
    for k, layer in enumerate(layers[1:], 1):
        ranks = ranks.union(layer.select("id", F.col("rank") * fresh[rounds - k]))
    ranks = ranks.groupBy("id").agg(F.sum("rank").alias("rank"))

    old = None
    for t in range(rounds, iterations):
        if t == rounds:
            old, ranks = kept(ranks.join(base, "id").select("id", "n", "rank"))
        even = (1 - alpha + alpha * dangling(ranks)) / n
        path, ranks = kept(base.join(sent(ranks), "id", "left").select("id", "n", (F.lit(even) + alpha * F.coalesce("g", F.lit(0.0))).alias("rank")))
        remove(spark, old)
        old = path
    links.unpersist()
    base.unpersist()
    return ranks.select("id", "rank")


def paths_from_navigation(rows: DataFrame, nodes: DataFrame, key: str = "name", path: str = "path") -> DataFrame:
    """src, dst of the consecutive pairs of ``a;b;<;c`` navigations; back steps drop out, an unknown name breaks the chain."""
    order = Window.partitionBy("__row").orderBy("pos")
    steps = rows.withColumn("__row", F.monotonically_increasing_id()).select("__row", F.posexplode(F.filter(F.split(path, ";"), lambda x: x != "<")).alias("pos", "name"))
    known = steps.join(nodes.select(F.col(key).alias("name"), "id"), "name", "left")
    return known.withColumn("src", F.lag("id").over(order)).filter("src is not null and id is not null").select("src", F.col("id").alias("dst"))


def overlap_ranking(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of ``a`` that ``b`` has as well (in a's order, columns id, pos), then the others of both by id."""
    ids_a, ids_b = a.select("id", "pos"), b.select("id")
    both = ids_a.join(ids_b.distinct(), "id", "left_semi").groupBy("id").agg(F.min("pos").alias("order")).select(F.lit(0).alias("group"), "order", "id")
    rest = ids_a.select("id").union(ids_b).distinct().join(both.select("id"), "id", "left_anti").select(F.lit(1).alias("group"), F.col("id").alias("order"), "id")
    return numbered(both.union(rest), ["group", "order"], column="rank").select("rank", "id")


def simple_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """cycle: the nodes of every simple cycle of at most ``max_length`` nodes, each once, from its least node on.

    Parallel edges count once.  Paths grow by one join a round and never go
    below the node they began with; there may be exponentially many cycles, so
    the length is a bound that the caller has to name.
    """
    links = cut(edges.select("src", "dst").distinct())
    paths = links.filter("src = dst").select(F.array("src").alias("cycle"))
    found = [paths]
    open_ = links.filter("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    for length in range(2, max_length + 1):
        grown = open_.join(links.select(F.col("src").alias("end"), F.col("dst").alias("next")), "end")
        found.append(grown.filter(F.col("next") == F.col("path")[0]).select(F.col("path").alias("cycle")))
        if length < max_length:
            longer = grown.filter((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next")))
            open_ = cut(longer.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("end")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
