import json

from latticework.operators import merge, views
from latticework.operators.graph import PropertyGraph
from latticework.sources import json_io


def test_views(spark):
    g = PropertyGraph.of(spark, [(["A"], {"title": "Hello World", "n": 1}), (["A"], {"text": "none"}), (["B"], {"n": 2.5})], [(1, "R", 2, {}), (1, "S", 2, {}), (2, "R", 3, {})])
    assert [r["id"] for r in views.text_search(g.nodes, "WORLD").collect()] == [1]
    assert sorted(r["id"] for r in views.simple_digraph(g.edges).collect()) == [2, 3]
    walks = spark.createDataFrame([("w", 1, 3, 5), ("v", 3, 1, 2)], "walk string, start long, goal long, hops int")
    assert sorted(tuple(r) for r in views.hop_comparison(walks, g.edges).collect()) == [("v", 2, None, None), ("w", 5, 2, 3)]
    found, edges = views.bfs_tree(g, 1, 1)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0), (2, 1)] and edges.count() == 2
    assert [tuple(r) for r in views.typed_view(g.nodes, "B", floats=["n"]).collect()] == [(3, 2.5)]
    assert [tuple(r) for r in views.missing_keys(g.nodes, {"A": ["n"]}).collect()] == [(2, "A", "n")]


def test_bulk_json_keeps_file_order(spark):
    doc = {"nodes": [{"id": 9, "labels": ["Z"]}, {"id": 4, "properties": {"k": 1}}], "edges": [{"from_node": 4, "to_node": 9, "label": "R"}]}
    g = json_io.bulk_json(spark, json.dumps(doc))
    assert g.get_node(1).labels == ("Z",) and (g.get_edge(1).from_node, g.get_edge(1).to_node) == (2, 1)


def test_merge_report_text(spark):
    left, right = PropertyGraph.of(spark, [(["P"], {"k": 1, "s": "a"})]), PropertyGraph.of(spark, [(["P"], {"k": 1, "s": "b"})])
    text = merge.format_text(merge.preview(left, right, ["k"]))
    assert "Can merge: yes" in text and "node_property_conflict 1 -> 1: s a / b" in text
