"""Append-only event log: Actor, Event and Source nodes with AUTHORED, CAUSED_BY and CITES edges."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import values as V
from latticework.operators.graph import Node, PropertyGraph, has_label
from latticework.operators.mutate import add_edges, add_nodes
from latticework.operators.subgraph import numbered


def now_text() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def event_name(number: Column) -> Column:
    """``event:`` and the number, in six digits at least; longer numbers stay whole."""
    digits = number.cast("string")
    return F.concat(F.lit("event:"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def ordered(nodes: DataFrame) -> DataFrame:
    """rank and the event's id, timestamp, operation, by (timestamp, event_id) as texts."""
    rows = nodes.filter(has_label(["Event"])).select(V.prop("event_id")["v"].alias("event_id"), V.prop("timestamp")["v"].alias("timestamp"), V.prop("operation")["v"].alias("operation"))
    return numbered(rows, ["timestamp", "event_id"], column="rank")


def ensure_actors(actors: DataFrame, keys: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """(all actors, those created): one new actor for each distinct key that has none; existing ones stay as they are."""
    have = actors.select(V.prop_str("key").alias("key"))
    missing = numbered(keys.select("key").distinct().join(have, "key", "left_anti"), ["key"], first_id)
    made = missing.select(F.col("new_id").alias("id"), F.array(F.lit("Actor")).alias("labels"), V.typed_props({"key": ("str", F.col("key"))}).alias("props"))
    return actors.unionByName(made), made


def unseen(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch whose event_id the log does not have; the first of equal ids."""
    have = log.select(V.prop_str("event_id").alias("event_id"))
    return batch.join(have, "event_id", "left_anti").dropDuplicates(["event_id"])


def next_event_id(nodes: DataFrame) -> DataFrame:
    """event_id: one above the highest number of an ``event:<digits>`` id."""
    number = F.regexp_extract(V.prop("event_id")["v"], r"^event:(\d+)$", 1)
    top = nodes.filter(has_label(["Event"])).agg(F.max(F.when(number != "", number.cast("long"))).alias("n"))
    return top.select(event_name(F.coalesce("n", F.lit(0)) + 1).alias("event_id"))


def list_events(graph: PropertyGraph) -> list[dict[str, Any]]:
    rows = graph.nodes.filter(has_label(["Event"])).orderBy(V.prop("timestamp")["v"], V.prop("event_id")["v"]).collect()
    return [Node.of(r).properties for r in rows]


def _by(graph: PropertyGraph, label: str, key: str, value: str) -> Node | None:
    row = graph.nodes.filter(has_label([label]) & (V.prop_str(key) == value)).orderBy("id").limit(1).first()
    return Node.of(row) if row else None


def ensure_actor(graph: PropertyGraph, key: str, legacy_agent_key: str | None = None, **props: Any) -> tuple[PropertyGraph, int]:
    """Get or create an actor by key; an existing one is not updated."""
    found = _by(graph, "Actor", "key", key)
    if found:
        return graph, found.id
    extra = {"agent_key": legacy_agent_key} if legacy_agent_key else {}
    graph, ids = add_nodes(graph, [(["Actor", "Agent"] if legacy_agent_key else ["Actor"], {"key": key, **extra, **props})])
    return graph, ids[0]


def append_event(
    graph: PropertyGraph, actor: str, operation: str, event_id: str | None = None, timestamp: str | None = None, payload: Mapping[str, Any] | None = None, caused_by: str | None = None, cites: str | None = None, parent_event_id: str | None = None
) -> tuple[PropertyGraph, str]:
    """Add an event and its edges; a cause or source that does not exist is passed over."""
    event_id = event_id or next_event_id(graph.nodes).first()["event_id"]
    if _by(graph, "Event", "event_id", event_id):
        raise ValueError(f"event {event_id} exists already")
    graph, actor_id = ensure_actor(graph, actor)
    graph, ids = add_nodes(graph, [(["Event"], {"event_id": event_id, "operation": operation, "timestamp": timestamp or now_text(), "payload": dict(payload or {}), "parent_event_id": parent_event_id})])
    links: list[tuple[int, str, int, dict]] = [(actor_id, "AUTHORED", ids[0], {})]
    if caused_by and (cause := _by(graph, "Event", "event_id", caused_by)):
        links.append((ids[0], "CAUSED_BY", cause.id, {}))
    if cites and (source := _by(graph, "Source", "key", cites)):
        links.append((ids[0], "CITES", source.id, {}))
    graph, _ = add_edges(graph, links)
    return graph, event_id


def previous_events(events: DataFrame) -> DataFrame:
    """Each event's predecessor of the same actor: actor, event_id, previous."""
    return events.withColumn("previous", F.lag("event_id").over(Window.partitionBy("actor").orderBy("timestamp", "event_id")))
