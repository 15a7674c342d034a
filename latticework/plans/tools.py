"""Tool functions: one call, one plain dictionary."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import functions as F

from latticework.errors import GraphError, UsageError
from latticework.functions import values as V
from latticework.operators import aggregate, diff, merge, mutate, subgraph, traverse
from latticework.operators.graph import Edge, Node, PropertyGraph, has_label
from latticework.sources import json_io
from latticework.sources.store import GraphStore

DEFAULT_NAME = "memory.graph"
#: The map of an empty graph, and the lines and marks of a trace's text.
EMPTY_MAP = "graph LR\n    empty[No nodes found]"
NO_PATH, NO_ROUTE = "Trace: (no path found)", "No route under the given constraints."
DECISION, WHY, FACTORS, REJECTED, DONE, PATH, DRAWN = "Decision found:", "Why:", "Key factors:", "Rejected:", "Implemented in:", "Path:", "Mermaid:"
YES, NO, NEXT = "✓ ", "✗ ", "→ "


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return default if value is None else max(low, min(high, int(value)))


def guarded(tool: Callable[..., dict]) -> Callable[..., dict]:
    """Errors as ``{"error": {"code", "message"}}``."""

    def run(*args: Any, **kwargs: Any) -> dict:
        try:
            return tool(*args, **kwargs)
        except (GraphError, ValueError, KeyError) as e:
            return {"error": {"code": type(e).__name__, "message": str(e)}}

    return run


def discover(folder: str = ".") -> str:
    """The one graph folder here; a default name where there is none; several are an error."""
    found = sorted(n for n in os.listdir(folder) if os.path.exists(os.path.join(folder, n, "CURRENT")))
    if len(found) > 1:
        raise UsageError(f"several graphs here: {', '.join(found)}")
    return os.path.join(folder, found[0] if found else DEFAULT_NAME)


def node_dict(n: Node) -> dict[str, Any]:
    """A flat record; a property named like a meta key is called ``prop_<name>``."""
    return {"id": n.id, "labels": list(n.labels)} | {k if k not in ("id", "labels") else f"prop_{k}": v for k, v in n.properties.items()}


def edge_dict(e: Edge) -> dict[str, Any]:
    meta = {"id": e.id, "label": e.label, "from": e.from_node, "to": e.to_node}
    return meta | {k if k not in meta else f"prop_{k}": v for k, v in e.properties.items()}


def stats(graph: PropertyGraph, path: str = ":memory:", size: int = 0) -> dict[str, Any]:
    hist = lambda df: {r["label"]: r["n"] for r in df.orderBy("label").collect()}
    return {"path": path, "format": json_io.FORMAT_VERSION, "file_size": size, "node_count": graph.node_count(), "edge_count": graph.edge_count(), "node_labels": hist(aggregate.label_histogram(graph.nodes)), "edge_labels": hist(aggregate.edge_label_histogram(graph.edges))}


@guarded
def overview(graph: PropertyGraph) -> dict[str, Any]:
    top = aggregate.top_degree(graph.nodes, graph.edges).join(graph.nodes, "id").orderBy(F.desc("degree"), "id").collect()
    return stats(graph) | {"samples": [node_dict(Node.of(r)) | {"degree": r["degree"]} for r in top]}


@guarded
def find(graph: PropertyGraph, where: Mapping[str, Any] | None = None, label: str | None = None, cursor: int = 0, limit: int | None = None) -> dict[str, Any]:
    page = graph.find_page(where or {}, label, cursor, clamp(limit, 1, 100, 20))
    return {"nodes": [node_dict(n) for n in page["nodes"]], "next_cursor": page["next_cursor"]}


@guarded
def explore(graph: PropertyGraph, node: int, depth: int | None = None, edge_label: str | None = None, shown: int = 50) -> dict[str, Any]:
    """The node and what is within ``depth`` hops, in order of discovery (first ``shown`` of all), and the edges among them; the label narrows only the edges shown."""
    graph.require(node)
    found = [node, *(r["id"] for r in traverse.bfs(graph, node, clamp(depth, 0, 4, 2)).limit(shown).collect())]
    order = {i: k for k, i in enumerate(found[:shown])}
    ids = graph.spark.createDataFrame([(i,) for i in order], "id long")
    edges = graph.edges_between(ids)
    if edge_label:
        edges = edges.filter(F.col("label") == edge_label)
    nodes = sorted(map(Node.of, graph.hydrate(ids).collect()), key=lambda n: order[n.id])
    return {
        "center": node_dict(nodes[0]),
        "nodes": [node_dict(n) for n in nodes],
        "edges": [edge_dict(Edge.of(e)) for e in edges.orderBy("id").collect()],
        "mermaid": subgraph.mermaid(graph.hydrate(ids), edges),
        "truncated": len(found) > shown,
    }


def title_of(n: dict[str, Any]) -> str:
    """Title, path or name of a flat record, else its labels and id."""
    for k in ("title", "path", "name"):
        if k in n:
            return str(n[k])
    return f"{'/'.join(n['labels'])} #{n['id']}" if n["labels"] else f"node {n['id']}"


def row_title(n: dict[str, Any]) -> str:
    return str(n["path"]) if "File" in n["labels"] and n.get("path") else title_of(n)


def filled(n: dict[str, Any], key: str) -> str:
    """A text property without the space around it; empty where it is none."""
    value = n.get(key)
    return value.strip() if isinstance(value, str) else ""


def factor(n: dict[str, Any], chosen: bool) -> str:
    """What a key factor's line says: its own words, of a chosen option the first half of its summary, else its title."""
    summary = n.get("summary")
    if own := filled(n, "key_factor"):
        return own
    if chosen and isinstance(summary, str) and " and " in summary:
        return summary.partition(" and ")[0].strip()
    return title_of(n)


def turned_down(n: dict[str, Any]) -> str:
    """A rejected option without its leading "Use ", its note in brackets."""
    title = title_of(n)
    title = title[4:].strip() if title.startswith("Use ") else title
    return f"{title} ({note})" if (note := filled(n, "rejection_note")) else title


def narrative(path: list[dict[str, Any]], branches: list[dict[str, Any]]) -> dict[str, Any]:
    """decision, why, factors, rejected, implemented of a path of flat records and the branches of its start."""
    on_path = {n["id"] for n in path}
    decision = next((n for n in path if "Decision" in n["labels"]), None)
    kinds: dict[str, list] = {"LEARNED_FROM": [], "CONSTRAINED_BY": [], "chosen": [], "rejected": []}
    for b in branches:
        label, n = b["edge_label"], b["target"]
        if label == "CONSIDERED" and "Option" in n["labels"]:
            label = "chosen" if n["id"] in on_path else "rejected"
        if label in kinds:
            kinds[label].append(n)
    ordered = [(n, k == "chosen") for k in ("LEARNED_FROM", "CONSTRAINED_BY", "chosen") for n in sorted(kinds[k], key=lambda n: n["id"])]
    reason = str((decision or {}).get("reason") or "")
    return {
        "decision": title_of(decision) if decision else None,
        "why": [x.strip() for x in reason.split(";") if x.strip()],
        "factors": [factor(n, chosen) for n, chosen in ordered],
        "rejected": [turned_down(n) for n in kinds["rejected"]],
        "implemented": row_title(path[-1]) if path and "File" in path[-1]["labels"] else None,
    }


@guarded
def trace(graph: PropertyGraph, start: int, goal: int, edge_label: str | None = None, source: str = "") -> dict[str, Any]:
    """Shortest path, the label of each hop, and the branches of the start."""
    path = traverse.shortest_path(graph, start, goal, edge_label or None)
    branches = [{"edge_label": r["label"], "target": node_dict(Node(r["to_node"], tuple(r["labels"] or ()), V.decode_props(r["props"])))} for r in traverse.branches(graph, start).collect()]
    base = {"source": source, "from_node": start, "to_node": goal, "edge_label": edge_label or "", "path": None, "mermaid": "", "reasoning_branches": branches, "path_hop_labels": []}
    if path is None:
        return base
    ids = path.select("id")
    nodes = {r["id"]: Node.of(r) for r in graph.hydrate(ids).collect()}
    ordered = [node_dict(nodes[r["id"]]) for r in path.orderBy("pos").collect()]
    hops = traverse.hop_labels(graph.edges, path, edge_label or None).orderBy("pos").collect()
    among = graph.edges_between(ids)
    if edge_label:
        among = among.filter(F.col("label") == edge_label)
    return base | {"path": ordered, "path_hop_labels": [h["label"] for h in hops], "mermaid": subgraph.mermaid(graph.hydrate(ids), among)}


def trace_text(payload: dict[str, Any], mermaid: bool = True) -> str:
    """A trace in sections: what it is about, the decision and why, factors, what was rejected, where it was done, the path."""
    label, path = payload["edge_label"], payload["path"]
    only = [f"Edge label filter: {label}"] if label else []
    if path is None:
        return "\n".join([NO_PATH, *only, "", NO_ROUTE])
    told = narrative(path, payload["reasoning_branches"])
    about = filled(path[0], "trace_prompt") or f"{title_of(path[0])} → {title_of(path[-1])}"
    sections = [[f"Trace: {about}", *only]]
    if told["decision"] is not None:
        sections.append([DECISION, told["decision"]])
    for head, mark, lines in ((WHY, YES, told["why"]), (FACTORS, YES, told["factors"]), (REJECTED, NO, told["rejected"]), (DONE, "", [told["implemented"]] * (told["implemented"] is not None))):
        if lines:
            sections.append([head, *(f"  {mark}{x}" for x in lines)])
    sections.append([PATH, *(f"  {NEXT if i else ''}{row_title(n)}" for i, n in enumerate(path))])
    if mermaid and payload["mermaid"]:
        sections.append([DRAWN, payload["mermaid"]])
    return "\n\n".join("\n".join(x) for x in sections)


@guarded
def map_tool(graph: PropertyGraph, ids: list[int] | None = None, limit: int | None = None) -> dict[str, Any]:
    rows = graph.nodes.filter(F.col("id").isin(*ids)) if ids else graph.nodes.orderBy("id").limit(clamp(limit, 1, 100, 30))
    chosen = rows.select("id")
    if chosen.isEmpty():
        return {"mermaid": EMPTY_MAP}
    edges = graph.edges_between(chosen)
    return {"mermaid": subgraph.mermaid(rows, edges)}


@guarded
def diff_tool(left: PropertyGraph, right: PropertyGraph, node_key: list[str] | None = None, rules: Mapping[str, list[str]] | None = None) -> dict[str, Any]:
    return diff.diff(left, right, node_key, rules)


@guarded
def merge_preview(dst: PropertyGraph, src: PropertyGraph, **options: Any) -> dict[str, Any]:
    return merge.preview(dst, src, **options)


@guarded
def manifest_tool(graph: PropertyGraph) -> dict[str, Any]:
    return json.loads(json_io.manifest(graph))


@guarded
def append(store: GraphStore, nodes: list[dict], edges: list[dict] | None = None) -> dict[str, Any]:
    """A batch of nodes with local names and edges between names or ids; any failure drops everything uncommitted."""
    try:
        refs: dict[str, int] = {}
        for n in nodes:
            if not n.get("labels"):
                raise ValueError("labels are required")
        graph, ids = mutate.add_nodes(store.graph, [(n["labels"], n.get("properties", {})) for n in nodes])
        for n, i in zip(nodes, ids, strict=True):
            if n.get("ref"):
                refs[n["ref"]] = i
        end = lambda x: refs[x] if isinstance(x, str) else int(x)
        graph, made = mutate.add_edges(graph, [(end(e["from"]), e["label"], end(e["to"]), e.get("properties", {})) for e in edges or []])
        store.graph = graph
        store.commit()
    except Exception:
        store.rollback()
        raise
    return {"nodes": ids, "edges": made, "refs": refs}


@guarded
def merge_tool(store: GraphStore, nodes: list[dict], edges: list[dict] | None = None) -> dict[str, Any]:
    """Per node: an id updates, a match (all labels, equal properties) updates its one hit, else a node is made; edges are got or made."""
    try:
        out, refs = [], {}
        for n in nodes:
            props = n.get("properties", {})
            if n.get("id") is not None:
                store.update_node(int(n["id"]), **props)
                i, how = int(n["id"]), "updated"
            else:
                match, hits = n.get("match"), []
                if match:
                    df = store.graph.nodes
                    for label in match.get("labels", []):
                        df = df.filter(has_label([label]))
                    for k, v in match.get("properties", {}).items():
                        df = df.filter(V.loose_key(V.prop(k)) == V.loose_key(V.value_lit(v)))
                    hits = [r["id"] for r in df.select("id").limit(2).collect()]
                if len(hits) > 1:
                    raise ValueError("ambiguous_match")
                if hits:
                    store.update_node(hits[0], **props)
                    i, how = hits[0], "updated"
                else:
                    i, how = store.add_node(n.get("labels") or (match or {}).get("labels", []), **((match or {}).get("properties", {}) | props)), "created"
            out.append({"id": i, "action": how})
            if n.get("ref"):
                refs[n["ref"]] = i
        end = lambda x: refs[x] if isinstance(x, str) else int(x)
        made = [store.merge_edge(end(e["from"]), e["label"], end(e["to"]), **e.get("properties", {})) for e in edges or []]
        store.commit()
    except Exception:
        store.rollback()
        raise
    return {"nodes": out, "edges": made}


# helpers of the coding-memory convention
def record_file(store: GraphStore, path: str, **props: Any) -> int:
    found = store.graph.find_file(path)
    if found:
        if props:
            store.update_node(found.id, **props)
        return found.id
    return store.add_node(["File"], path=path, **props)


def record_decision(store: GraphStore, title: str, **props: Any) -> int:
    return store.add_node(["Decision"], title=title, **props)


def record_bug(store: GraphStore, title: str, **props: Any) -> int:
    return store.add_node(["Task"], **({"title": title} | props | {"task_kind": "bug"}))


def link(store: GraphStore, src: int, label: str, dst: int, **props: Any) -> int:
    return store.merge_edge(src, label, dst, **props)


def context_packet(graph: PropertyGraph, start: int, depth: int = 2) -> str:
    """Texts of what is near a node, indented by depth."""
    keys = ("text", "title", "summary", "path", "result")
    found = traverse.bfs(graph, start, depth)
    text = F.coalesce(*[F.when(V.prop_str(k) != "", V.prop_str(k)) for k in keys], F.lit(""))
    rows = found.join(graph.nodes, "id").orderBy("rank").select("depth", F.element_at("labels", 1).alias("label"), text.alias("text")).collect()
    return "\n".join(f"{'  ' * r['depth']}- {r['label']}: {r['text']}" for r in rows)
