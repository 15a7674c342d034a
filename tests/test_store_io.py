import json

import pytest

from latticework.errors import AlreadyOpenError, CorruptedGraphError, TransactionError, UsageError
from latticework.operators import events
from latticework.operators.graph import PropertyGraph
from latticework.plans import cli, tools
from latticework.sources import csv_io, json_io
from latticework.sources.store import GraphStore
from latticework.streaming import event_stream


def test_commit_rollback_transaction(spark, tmp_path):
    path = str(tmp_path / "g")
    with GraphStore(spark, path) as s:
        a = s.add_node(["P"], name="A")
        s.commit()
        s.add_node(["P"], name="B")
        s.rollback()
        assert s.graph.node_count() == 1
        with pytest.raises(RuntimeError), s.transaction():
            s.add_node(["P"])
            raise RuntimeError
        with s.transaction():
            b = s.add_node(["P"], name="C")
            s.add_edge(a, "R", b)
            with pytest.raises(TransactionError), s.transaction():
                pass
            with pytest.raises(TransactionError):
                s.vacuum()
        with pytest.raises(AlreadyOpenError):
            GraphStore(spark, path)
    with pytest.raises(ValueError):
        s.add_node(["P"])
    with GraphStore(spark, path) as s:
        assert (s.graph.node_count(), s.graph.edge_count()) == (2, 1)
        s.delete_node(2)
        s.commit()
        s.vacuum()
        assert s.add_node(["P"]) == 3
        assert s.repair_adjacency() == {"nodes_rewritten": 2, "edges_relinked": 0}
        s.clear()
        assert s.add_node(["P"]) == 1
        assert s.info()["node_count"] == 1


def test_memory_store(spark):
    with GraphStore(spark) as s:
        s.add_node(["P"])
        s.commit()
        assert s.info() == {"version": "1.0", "node_count": 1, "edge_count": 0, "file_size": 0}


@pytest.fixture
def small(spark):
    return PropertyGraph.of(spark, [(["B", "A"], {"name": 'q"uote', "n": 1, "f": 1.5, "none": None}), (["A"], {"list": [1, "x"]})], [(1, "R", 2, {"w": True})])


def test_export_import_manifest_sign(spark, small):
    text = json_io.export_json(small)
    data = json.loads(text)
    assert list(data) == sorted(data) and data["nodes"][0]["labels"] == ["A", "B"] and text.endswith("}\n")
    back = json_io.import_json(spark, text)
    assert json_io.export_json(back) == text
    signed = json_io.sign(small, b"key")
    assert json_io.verify(back, b"key", signed)["valid"] and not json_io.verify(back, b"other", signed)["valid"]
    lines = [json.loads(r["line"]) for r in json_io.node_lines(small.nodes.filter("id = 1")).collect()]
    assert lines[0] == data["nodes"][0]


def test_import_renumbers_and_refuses(spark, tmp_path):
    doc = {"export_version": 1, "nodes": [{"id": 20, "labels": [], "properties": {"k": "B"}}, {"id": 10, "labels": [], "properties": {"k": "A"}}], "edges": [{"id": 99, "from_node": 20, "to_node": 10, "label": "R", "properties": {}}]}
    g = json_io.import_json(spark, json.dumps(doc))
    assert g.get_node(1)["k"] == "A" and (g.get_edge(1).from_node, g.get_edge(1).to_node) == (2, 1)
    for broken in ([], doc | {"export_version": 2}, doc | {"nodes": doc["nodes"][:1]}, doc | {"nodes": [{"id": "x"}]}):
        with pytest.raises(UsageError):
            json_io.import_json(spark, json.dumps(broken))
    file = tmp_path / "d.json"
    file.write_text(json.dumps(doc | {"extra": [1]}, indent=2))
    g = json_io.import_document(spark, str(file))
    assert g.get_node(1)["k"] == "A" and (g.get_edge(1).from_node, g.get_edge(1).to_node) == (2, 1)
    node = doc["nodes"][0]
    for broken in ([], doc | {"export_version": 2}, doc | {"nodes": doc["nodes"][:1]}, doc | {"nodes": [{"id": "x"}]}, doc | {"nodes": [node | {"properties": [1]}]}, doc | {"nodes": [node | {"labels": [None]}]}, doc | {"edges": None}):
        file.write_text(json.dumps(broken))
        with pytest.raises(UsageError):
            json_io.import_document(spark, str(file))
    file.write_text("{not json")
    with pytest.raises(UsageError):
        json_io.import_document(spark, str(file))
    with pytest.raises(UsageError):
        json_io.manifest(PropertyGraph.of(spark, [([], {"x": float("nan")})]))


def test_lines_and_csv_round_trip(spark, small, tmp_path):
    json_io.write_lines(small, str(tmp_path / "lines"))
    assert json_io.export_json(json_io.read_lines(spark, str(tmp_path / "lines"))) == json_io.export_json(small)
    (tmp_path / "n.csv").write_text("id,labels,age,score,ok,name\na,P|Q,3,1.5,true,Al\nb,P,,,,\n")
    (tmp_path / "e.csv").write_text("from_id,label,to_id,since\na,KNOWS,b,2020\n")
    g = csv_io.read_graph(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert g.get_node(1).properties == {"age": 3, "score": 1.5, "ok": True, "name": "Al"} and g.get_node(2).properties == {}
    assert g.get_edge(1).properties == {"since": 2020}
    csv_io.write_nodes(g.nodes, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["id", "labels", "age", "name", "ok", "score"]
    (tmp_path / "gn.csv").write_text('graph,order,ref,labels,properties_json\ng1,2,b,P,{}\ng1,1,a,P;Q,"{""k"": 1}"\ng2,1,z,P,{}\n')
    (tmp_path / "ge.csv").write_text("graph,order,from_ref,label,to_ref,properties_json\ng1,1,a,R,b,{}\n")
    named = csv_io.read_named_graph(spark, str(tmp_path / "gn.csv"), str(tmp_path / "ge.csv"), "g1")
    assert named.get_node(1)["k"] == 1 and named.edge_count() == 1


def test_dangling_remap(spark):
    from latticework.operators.subgraph import remapped

    g = PropertyGraph.of(spark, [([], {})], [(1, "R", 5, {})])
    with pytest.raises(CorruptedGraphError):
        remapped(g.nodes, g.edges)


def test_event_log(spark):
    g = PropertyGraph.empty(spark)
    g, first = events.append_event(g, "ann", "start", timestamp="2024-01-01T00:00:00Z", payload={"a": [1]})
    g, second = events.append_event(g, "ann", "stop", timestamp="2024-01-02T00:00:00Z", caused_by=first, cites="nothing")
    assert (first, second) == ("event:000001", "event:000002")
    assert [e["operation"] for e in events.list_events(g)] == ["start", "stop"]
    assert sorted(r["label"] for r in g.edges.collect()) == ["AUTHORED", "AUTHORED", "CAUSED_BY"]
    with pytest.raises(ValueError):
        events.append_event(g, "ann", "again", event_id=first)
    same, actor = events.ensure_actor(g, "ann", name="other")
    assert actor == 1 and same is g
    assert set(events.ensure_actor(g, "bot", legacy_agent_key="x")[0].nodes.orderBy("id").collect()[-1]["labels"]) == {"Actor", "Agent"}


def test_event_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("event:000001", "ann", "start", "t1"), ("event:000002", "bob", "stop", "t2"), ("event:000002", "bob", "stop", "t2")]
    spark.createDataFrame(rows, "event_id string, actor string, operation string, timestamp string").coalesce(1).write.json(str(src))
    with GraphStore(spark) as s:
        stream = spark.readStream.schema("event_id string, actor string, operation string, timestamp string").json(str(src))
        event_stream.append_stream(s, stream, str(tmp_path / "cp")).awaitTermination()
        assert len(events.list_events(s.graph)) == 2 and s.graph.edge_count() == 2


TRACE_NODES = [(["Task"], {"title": "T"}), (["Option"], {"name": "O1"}), (["Option"], {"name": "O2"}), (["Decision"], {"title": "D", "reason": "fast; safe"}), (["File"], {"path": "f.py"})]
TRACE_EDGES = [(1, "CONSIDERED", 2, {}), (1, "CONSIDERED", 3, {}), (2, "SUPPORTS", 4, {}), (4, "IMPLEMENTED_IN", 5, {})]


def test_tools(spark, tmp_path):
    g = PropertyGraph.of(spark, TRACE_NODES, TRACE_EDGES)
    t = tools.trace(g, 1, 5)
    assert [n["id"] for n in t["path"]] == [1, 2, 4, 5] and t["path_hop_labels"] == ["CONSIDERED", "SUPPORTS", "IMPLEMENTED_IN"]
    assert t["path"][0] == {"id": 1, "labels": ["Task"], "title": "T"} and t["reasoning_branches"][1] == {"edge_label": "CONSIDERED", "target": {"id": 3, "labels": ["Option"], "name": "O2"}}
    assert tools.narrative(t["path"], t["reasoning_branches"]) == {"decision": "D", "why": ["fast", "safe"], "factors": ["O1"], "rejected": ["O2"], "implemented": "f.py"}
    e = tools.explore(g, 1, 1)
    assert [n["id"] for n in e["nodes"]] == [1, 3, 2] and not e["truncated"]
    assert e["edges"][0] == {"id": 1, "label": "CONSIDERED", "from": 1, "to": 2}
    assert e["mermaid"].splitlines()[:2] == ["graph LR", '    N1["Task:T"]']
    assert tools.explore(g, 1, 1, shown=2)["truncated"]
    assert tools.explore(g, 99)["error"]["code"] == "NodeNotFoundError"
    assert tools.overview(g)["samples"][0]["id"] == 1
    assert tools.map_tool(PropertyGraph.empty(spark)) == {"mermaid": "graph LR\n    empty[No nodes found]"}
    assert tools.context_packet(g, 1, 1).splitlines()[0].startswith("  - Option")
    with GraphStore(spark) as s:
        made = tools.append(s, [{"ref": "a", "labels": ["P"]}, {"ref": "b", "labels": ["P"], "properties": {"k": 1}}], [{"from": "a", "label": "R", "to": "b"}])
        assert made["refs"] == {"a": 1, "b": 2}
        assert "error" in tools.append(s, [{"labels": []}])
        m = tools.merge_tool(s, [{"match": {"labels": ["P"], "properties": {"k": 1}}, "properties": {"z": 2}}, {"match": {"labels": ["P"], "properties": {"k": 9}}}])
        assert [x["action"] for x in m["nodes"]] == ["updated", "created"]
        assert tools.record_file(s, "x.py") == tools.record_file(s, "x.py")


def test_cli(spark, tmp_path, capsys):
    a, b, out = (str(tmp_path / n) for n in "abo")
    for path, nodes in ((a, TRACE_NODES), (b, TRACE_NODES[:2])):
        with GraphStore(spark, path) as s:
            s.graph = PropertyGraph.of(spark, nodes, TRACE_EDGES[:1])
            s.commit()
    assert cli.main(["version"], spark) == 0
    assert cli.main(["diff", a, a + "x"], spark) == 1
    assert cli.main(["diff", a, b], spark) == 1
    assert cli.main(["merge", a, b], spark) == 2
    assert cli.main(["merge", a, b, "-o", out], spark) == 0
    assert cli.main(["merge", a, b, "-o", out], spark) == 2
    assert cli.main(["stats", out], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["node_count"] == 7
    assert cli.main(["export", a, "-o", str(tmp_path / "a.json")], spark) == 0
    assert cli.main(["import", str(tmp_path / "a.json"), "-o", str(tmp_path / "again")], spark) == 0
    (tmp_path / "key").write_text("k")
    capsys.readouterr()
    assert cli.main(["sign", a, "--key-file", str(tmp_path / "key")], spark) == 0
    (tmp_path / "sig").write_text(capsys.readouterr().out)
    assert cli.main(["verify", str(tmp_path / "again"), "--key-file", str(tmp_path / "key"), "--signature", str(tmp_path / "sig")], spark) == 0
    assert cli.main(["trace", a, "1", "2"], spark) == 0 and cli.main(["trace", a, "1", "5"], spark) == 1
    assert cli.main(["pack", a, "--include-labels", "Task", "-o", str(tmp_path / "p")], spark) == 0
    assert cli.main(["events", "append", a, '{"actor": "ann", "operation": "x"}'], spark) == 0
    assert cli.main(["nonsense"], spark) == 2


def test_lines_of_odd_keys_and_floats(spark, tmp_path):
    g = PropertyGraph.of(spark, [(["A"], {'ke"y\\': 1, "f": 1e20, "g": 0.1, "m": {"a": [1, 2.5, None, True, "x\n"]}}), (["B"], {})], [(1, 'la"bel', 2, {'k"': None})])
    json_io.write_lines(g, str(tmp_path / "lines"))
    back = json_io.read_lines(spark, str(tmp_path / "lines"))
    assert json_io.export_json(back) == json_io.export_json(g)
    plain = PropertyGraph.of(spark, [(["A"], {'ke"y': 1.5})])
    assert json.loads(json_io.node_lines(plain.nodes).first()["line"]) == {"id": 1, "labels": ["A"], "properties": {'ke"y': 1.5}}
    with pytest.raises(Exception, match="NaN"):
        json_io.node_lines(PropertyGraph.of(spark, [([], {"x": float("inf")})]).nodes).collect()


def test_streamed_document_is_the_whole_one(spark, small):
    for kind in ("export_version", "manifest_version"):
        assert "".join(json_io.document_parts(small, kind)) == json_io.dumps(json_io.document(small, kind))
        assert "".join(json_io.document_parts(PropertyGraph.empty(spark), kind)) == json_io.dumps(json_io.document(PropertyGraph.empty(spark), kind))
    assert json.loads(json_io.plain_json(small))["nodes"][0]["labels"] == ["B", "A"]


def python_cell(value):
    for make in (int, float):
        try:
            return make(value)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(value.lower(), value)


def test_cells_like_python_reads_them(spark, tmp_path):
    cells = ["1", " 5", "5 ", "+7", "-3", "1_000", "1__0", "_1", "12d", "3F", "1.", ".5", "1e5", "1E-3", "1_0.5", "inf", "-Infinity", "true", "FALSE", " true", "0x10", "12345678901234567890123", "1.5f", "abc", "1 2", "--1", "1e", "."]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    from pyspark.sql import functions as F

    from latticework.functions import values as V

    got = {r["i"]: V.decode(*r["v"]) for r in rows.select("i", csv_io.coerced(F.col("c")).alias("v")).collect()}
    for i, c in enumerate(cells):
        want = python_cell(c)
        if isinstance(want, int) and not isinstance(want, bool) and abs(want) >= 2**63:
            want = float(want)
        assert got[i] == want and type(got[i]) is type(want), c


def test_csv_in_file_order_with_known_ends_only(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,labels,k\nz, P | Q ,1\na,P,2\nm,,3\n")
    (tmp_path / "e.csv").write_text("from_id,label,to_id\nz,R,a\na,R,z\n")
    g = csv_io.read_graph(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert [(n.id, n.labels, n["k"]) for n in g.query_nodes().fetch()] == [(1, ("P", "Q"), 1), (2, ("P",), 2), (3, (), 3)]
    assert [(e.from_node, e.to_node) for e in g.query_edges().fetch()] == [(1, 2), (2, 1)]
    (tmp_path / "bad.csv").write_text("from_id,label,to_id\nz,R,a\na,R,nobody\n")
    with pytest.raises(UsageError, match="nobody"):
        csv_io.read_graph(spark, str(tmp_path / "n.csv"), str(tmp_path / "bad.csv"))


def test_vacuum_commits_what_is_staged(spark, tmp_path):
    path = str(tmp_path / "v")
    with GraphStore(spark, path) as s:
        s.add_node(["P"])
        s.commit()
        s.add_node(["Q"])
        s.vacuum()
        s.rollback()
        assert s.graph.node_count() == 2
    with GraphStore(spark, path) as s:
        assert s.graph.node_count() == 2 and s.add_node(["P"]) == 3


def test_trace_as_text(spark):
    nodes = [
        (["Decision"], {"title": "Cache it", "reason": "fast; safe ;", "trace_prompt": " Why a cache? "}),
        (["Option"], {"title": "Use Redis", "summary": "Known here and quick"}),
        (["Option"], {"title": "Use files", "rejection_note": " too slow "}),
        (["Option"], {"name": "Memory"}),
        (["Incident"], {"title": "Outage", "key_factor": " the big outage "}),
        (["Rule"], {}),
        (["File"], {"title": "t", "path": "cache.py"}),
    ]
    edges = [(1, "CONSIDERED", 2, {}), (1, "CONSIDERED", 3, {}), (1, "CONSIDERED", 4, {}), (1, "LEARNED_FROM", 5, {}), (1, "CONSTRAINED_BY", 6, {}), (2, "DONE_IN", 7, {})]
    g = PropertyGraph.of(spark, nodes, edges)
    got = tools.trace_text(tools.trace(g, 1, 7), mermaid=False)
    assert got.splitlines() == [
        "Trace: Why a cache?", "", "Decision found:", "Cache it", "", "Why:", "  ✓ fast", "  ✓ safe", "", "Key factors:", "  ✓ the big outage", "  ✓ Rule #6", "  ✓ Known here", "",
        "Rejected:", "  ✗ files (too slow)", "  ✗ Memory", "", "Implemented in:", "  cache.py", "", "Path:", "  Cache it", "  → Use Redis", "  → cache.py",
    ]
    assert tools.trace_text(tools.trace(g, 7, 1, "X")).splitlines() == ["Trace: (no path found)", "Edge label filter: X", "", "No route under the given constraints."]
    assert tools.trace_text(tools.trace(g, 2, 7)).splitlines()[-4:] == ["graph LR", '    N2["Option:Use Redis"]', '    N7["File:t"]', "    N2 -->|DONE_IN| N7"]


def test_force_keeps_the_old_graph_when_the_new_one_fails(spark, tmp_path):
    out, text = str(tmp_path / "out"), tmp_path / "broken.json"
    with GraphStore(spark, out) as s:
        s.add_node(["P"])
        s.commit()
    text.write_text("{}")
    assert cli.main(["import", str(text), "-o", out, "--force"], spark) == 2
    with GraphStore(spark, out) as s:
        assert s.graph.node_count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["broken.json", "out"]
