"""Command line: ``python -m latticework.plans.cli <command>``.  Exit codes: 0 fine, 1 different or refused, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from typing import Any

from pyspark.sql import SparkSession

from latticework.errors import GraphError, UsageError
from latticework.operators import diff, events, merge, subgraph
from latticework.plans import tools
from latticework.sources import json_io
from latticework.sources.folder import Folder
from latticework.sources.store import GraphStore

VERSION = "0.1.0"


def emit(value: Any) -> None:
    print(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str))


def rules_of(spark: SparkSession, path: str | None) -> dict[str, list[str]] | None:
    if path is None:
        return None
    data = json.loads(Folder(spark, path).read())
    rules = data.get("identity_rules") if isinstance(data, dict) else None
    if not isinstance(rules, dict) or not rules or not all(isinstance(v, list) and v and all(isinstance(k, str) for k in v) for v in rules.values()):
        raise UsageError("identity rules must map labels to lists of keys")
    return rules


def keys_of(text: str | None) -> list[str] | None:
    return [k.strip() for k in text.split(",") if k.strip()] if text else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latticework")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("help")

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    for name, args in (("diff", ("left", "right")), ("merge", ("left", "right"))):
        c = command(name, *args)
        c.add_argument("--node-key")
        c.add_argument("--identity-rules")
        c.add_argument("--format", choices=("json", "text"), default="json")
        if name == "merge":
            c.add_argument("-o", "--output")
            c.add_argument("--edge-strategy", choices=merge.EDGES, default="append")
            c.add_argument("--on-node-conflict", choices=merge.CONFLICTS, default="keep_dst")
            c.add_argument("--dry-run", action="store_true")
            c.add_argument("--fail-on-conflict", action="store_true")
            c.add_argument("--force", action="store_true")
    c = command("pack", "graph")
    c.add_argument("--include-labels", required=True)
    for x in (c, command("export", "graph"), command("import", "file")):
        x.add_argument("-o", "--output", required=x.prog.split()[-1] != "export")
        x.add_argument("--force", action="store_true")
    for name in ("manifest", "stats"):
        command(name, "graph")
    for name in ("sign", "verify"):
        c = command(name, "graph")
        c.add_argument("--key-file", required=True)
        if name == "verify":
            c.add_argument("--signature", required=True)
    c = command("trace", "graph")
    c.add_argument("start", type=int)
    c.add_argument("goal", type=int)
    c.add_argument("--edge-label")
    c.add_argument("--format", choices=("json", "text"), default="json")
    c.add_argument("--no-mermaid", action="store_true")
    c = command("events", "action", "graph")
    c.add_argument("payload", nargs="?")
    return p


def free(spark: SparkSession, path: str, force: bool) -> None:
    if not force and Folder(spark, path).exists():
        raise UsageError(f"{path} exists; use --force to replace it")


def save(spark: SparkSession, graph, path: str) -> None:
    """Write a graph folder beside ``path`` and put it in its place; an old one goes only when the new one is whole."""
    temporary = Folder(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    try:
        with GraphStore(spark, temporary.path) as out:
            out.graph = graph
            out.commit()
        Folder(spark, path).delete()
        temporary.move(path)
    finally:
        temporary.delete()


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "version":
        emit({"version": VERSION})
        return 0
    if a.command == "help":
        parser().print_help()
        return 0
    if a.command in ("diff", "merge"):
        if a.node_key and a.identity_rules:
            raise UsageError("--node-key and --identity-rules exclude each other")
        keys, rules = keys_of(a.node_key), rules_of(spark, a.identity_rules)
        with GraphStore(spark, a.left) as left, GraphStore(spark, a.right) as right:
            if a.command == "diff":
                report = diff.diff(left.graph, right.graph, keys, rules)
                print(diff.format_text(report)) if a.format == "text" else emit(report)
                return int(report["changed"])
            if a.fail_on_conflict and not a.dry_run:
                raise UsageError("--fail-on-conflict needs --dry-run")
            if a.dry_run:
                report = merge.preview(left.graph, right.graph, keys, rules, a.edge_strategy, a.on_node_conflict)
                print(merge.format_text(report)) if a.format == "text" else emit(report)
                return int(a.fail_on_conflict and not report["can_merge"])
            if not a.output or Folder(spark, a.output).path in (left.path, right.path):
                raise UsageError("merge needs an output other than its inputs")
            if rules and not merge.rule_conflicts(left.graph.nodes, right.graph.nodes, rules).isEmpty():
                raise UsageError("conflicts; see --dry-run")
            free(spark, a.output, a.force)
            result = merge.merge_from(left.graph, right.graph, keys, a.edge_strategy, a.on_node_conflict, rules)
            report = result.report()
            save(spark, result.graph, a.output)
            emit(report)
        return 0
    if a.command == "import":
        free(spark, a.output, a.force)
        if not Folder(spark, a.file).exists():
            raise UsageError(f"{a.file} does not exist")
        save(spark, json_io.import_document(spark, a.file), a.output)
        emit({"imported": True})
        return 0
    with GraphStore(spark, a.graph) as store:
        g = store.graph
        if a.command == "pack":
            packed = subgraph.pack(g, a.include_labels.split(","))
            free(spark, a.output, a.force)
            counts = {"node_count": packed.node_count(), "edge_count": packed.edge_count()}
            save(spark, packed, a.output)
            emit(counts)
        elif a.command == "export":
            parts = json_io.document_parts(g, "export_version")
            json_io.save(spark, parts, a.output, a.force) if a.output else sys.stdout.writelines(parts)
        elif a.command == "manifest":
            sys.stdout.writelines(json_io.document_parts(g, "manifest_version"))
        elif a.command == "stats":
            emit(tools.stats(g, a.graph, store.file_size()))
        elif a.command in ("sign", "verify"):
            key = Folder(spark, a.key_file).read().encode()
            if a.command == "sign":
                emit(json_io.sign(g, key))
                return 0
            report = json_io.verify(g, key, json.loads(Folder(spark, a.signature).read()))
            emit(report)
            return int(not report["valid"])
        elif a.command == "trace":
            report = tools.trace(g, a.start, a.goal, a.edge_label, a.graph)
            if a.format == "text" and "error" not in report:
                print(tools.trace_text(report, not a.no_mermaid))
            else:
                emit(report)
            return int("error" in report or report["path"] is None)
        elif a.command == "events":
            if a.action == "list":
                emit(events.list_events(g))
            elif a.action == "append":
                text = a.payload or "{}"
                if text.startswith("@"):
                    text = Folder(spark, text[1:]).read()
                store.graph, event_id = events.append_event(g, **json.loads(text))
                store.commit()
                emit({"event_id": event_id})
            else:
                raise UsageError("events append or events list")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("latticework").getOrCreate()
    try:
        return run(spark, a)
    except (GraphError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
