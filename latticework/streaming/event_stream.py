"""Appending a stream of events to the log; an extension beside the batch functions of operators.events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticework.functions import values as V
from latticework.functions.checkpoints import cut
from latticework.operators.graph import PropertyGraph, has_label
from latticework.operators.subgraph import numbered
from latticework.sources.store import GraphStore


def staged(graph: PropertyGraph, batch: DataFrame) -> PropertyGraph:
    """The graph with a batch of (event_id, actor, operation, timestamp) rows that it does not have yet."""
    log = graph.nodes.filter(has_label(["Event"])).select(V.prop_str("event_id").alias("event_id"))
    new = cut(batch.join(log, "event_id", "left_anti").dropDuplicates(["event_id"]))
    actors = graph.nodes.filter(has_label(["Actor"])).select("id", V.prop_str("key").alias("actor"))
    first = graph.next_id("node")
    made_actors = numbered(new.select("actor").distinct().join(actors.select("actor"), "actor", "left_anti"), ["actor"], first, "id")
    count = made_actors.count()
    made_events = numbered(new, ["timestamp", "event_id"], first + count, "id")
    nodes = graph.nodes.unionByName(made_actors.select("id", F.array(F.lit("Actor")).alias("labels"), V.typed_props({"key": ("str", F.col("actor"))}).alias("props")))
    nodes = nodes.unionByName(made_events.select("id", F.array(F.lit("Event")).alias("labels"), V.typed_props({k: ("str", F.col(k)) for k in ("event_id", "operation", "timestamp")}).alias("props")))
    known = actors.select("actor", "id").unionByName(made_actors.select("actor", "id"))
    links = made_events.select(F.col("id").alias("dst"), "actor").join(known.withColumnRenamed("id", "src"), "actor")
    edges = numbered(links, ["dst"], graph.next_id("edge"), "id").select("id", "src", "dst", F.lit("AUTHORED").alias("label"), F.create_map().cast(V.PROPS_TYPE).alias("props"))
    return PropertyGraph(nodes, graph.edges.unionByName(edges))


def append_stream(store: GraphStore, events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Commit each micro-batch of an event stream; replayed batches add nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        store.graph = staged(store.graph, batch)
        store.commit()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and hour with a watermark for late ones; (ts, event_type) rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
