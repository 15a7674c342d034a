import pytest
from pyspark.sql import functions as F

from latticework.errors import EdgeNotFoundError, NodeNotFoundError
from latticework.functions import values as V
from latticework.operators import aggregate, mutate, subgraph
from latticework.operators.graph import PropertyGraph


@pytest.fixture(scope="module")
def people(spark):
    return PropertyGraph.of(
        spark,
        [(["Person"], {"name": "Alice", "age": 30}), (["Person"], {"name": "Bob", "age": 19}), (["Person"], {"name": "Carol", "age": 42}), (["Company"], {"name": "Acme"})],
        [(1, "KNOWS", 2, {"since": 2022}), (1, "KNOWS", 3, {"since": 2018}), (2, "LIKES", 3, {"score": 5})],
    )


def names(rows):
    return [r.get("name") for r in rows]


def test_labels_are_alternatives_and_results_ascend(people):
    q = people.query_nodes()
    assert names(q.label("Company").label("Person").fetch()) == ["Alice", "Bob", "Carol", "Acme"]
    assert names(q.label("Company").fetch()) == ["Acme"]
    assert len(q.fetch()) == 4
    assert [e.id for e in people.query_edges().label("KNOWS").label("LIKES").fetch()] == [1, 2, 3]


def test_where_column_callback_and_replacement(people):
    q = people.query_nodes().label("Person")
    assert names(q.where_(V.prop_int("age") >= 30).fetch()) == ["Alice", "Carol"]
    assert names(q.where_(lambda n: n["age"] < 20).fetch()) == ["Bob"]
    assert names(q.where_(lambda n: False).where_(V.prop_int("age") > 40).fetch()) == ["Carol"]
    assert [e.id for e in people.query_edges().where_(lambda e: e.get("since", 0) > 2020).fetch()] == [1]


def test_skip_limit_count_exists(people):
    q = people.query_nodes().label("Person")
    assert names(q.skip(1).limit(1).fetch()) == ["Bob"]
    assert q.skip(1).count() == 2 and q.limit(2).count() == 2 and q.skip(9).count() == 0
    assert q.limit(0).count() == 0 and q.limit(0).fetch() == []
    assert q.exists() and q.skip(2).exists() and not q.skip(3).exists()
    assert q.skipped is None, "builders do not change"


def test_point_reads(people):
    assert people.get_node(1)["name"] == "Alice" and people.get_node(0) is None and people.get_node(99) is None
    assert people.get_edge(3).label == "LIKES" and people.get_edge(7) is None
    assert people.node_count() == 4 and people.edge_count() == 3
    node = people.get_node(4)
    assert "name" in node and "age" not in node and node.get("age", 1) == 1
    with pytest.raises(KeyError):
        node["age"]


def test_neighbours(spark):
    g = PropertyGraph.of(spark, [([], {})] * 4, [(1, "KNOWS", 2, {}), (1, "LIKES", 3, {}), (4, "FOLLOWS", 1, {}), (1, "KNOWS", 2, {}), (1, "SELF", 1, {})])
    ids = lambda d, label=None: [r["id"] for r in g.neighbours(1, label, d).collect()]
    assert ids("out") == [1, 2, 3, 2]
    assert ids("in") == [1, 4]
    assert ids("both") == [1, 2, 3, 4]
    assert ids("out", "KNOWS") == [2, 2]
    with pytest.raises(ValueError):
        g.neighbours(1, None, "sideways")
    with pytest.raises(NodeNotFoundError):
        g.out_edges(9)
    assert [r["id"] for r in g.out_edges(1).collect()] == [5, 4, 2, 1]


def test_degrees(spark):
    g = PropertyGraph.of(spark, [([], {})] * 3, [(1, "L", 1, {}), (1, "L", 2, {}), (1, "L", 2, {})])
    assert {r["id"]: (r["out_degree"], r["in_degree"]) for r in aggregate.degree_stats(g.edges).collect()} == {1: (3, 1), 2: (0, 2)}
    assert {r["id"]: r["out_degree"] for r in aggregate.degree_all(g.nodes, g.edges).collect()} == {1: 3, 2: 0, 3: 0}
    assert [r["id"] for r in aggregate.top_degree(g.nodes, g.edges).collect()] == [1, 2]
    assert [r["id"] for r in aggregate.top_degree(g.nodes, g.edges.limit(0)).collect()] == [1, 2, 3]


def test_edges_between_and_pack(people):
    assert [r["id"] for r in people.edges_between([1, 2]).collect()] == [1]
    packed = subgraph.pack(people, [" Company", "Company"])
    assert [(r["id"], V.decode_props(r["props"])) for r in packed.nodes.collect()] == [(1, {"name": "Acme"})]
    everyone = subgraph.pack(people, ["Person"])
    assert [(r["id"], r["src"], r["dst"]) for r in everyone.edges.orderBy("id").collect()] == [(1, 1, 2), (2, 1, 3), (3, 2, 3)]


def test_writes(people):
    g = mutate.update_node(people, 1, age=31, city="Bern")
    assert g.get_node(1).properties == {"name": "Alice", "age": 31, "city": "Bern"}
    g = mutate.delete_node(g, 3)
    assert g.node_count() == 3 and [r["id"] for r in g.all_edges().collect()] == [1]
    g, ids = mutate.add_nodes(g, [([], {})])
    assert ids == [5], "ids are never used again"
    with pytest.raises(NodeNotFoundError):
        mutate.add_edges(g, [(1, "X", 3, {})])
    with pytest.raises(EdgeNotFoundError):
        mutate.delete_edge(g, 3)
    with pytest.raises(NodeNotFoundError):
        mutate.update_node(g, 3, a=1)
    assert mutate.delete_edge(g, 1).edge_count() == 0


def test_merge_edge_takes_the_newest_strict_match(spark):
    g = PropertyGraph.of(spark, [([], {})] * 2, [(1, "L", 2, {"w": 1}), (1, "L", 2, {"w": 1}), (1, "L", 2, {"w": 1.0})])
    assert mutate.merge_edge(g, 1, "L", 2, w=1)[1] == 2
    assert mutate.merge_edge(g, 1, "L", 2, w=1.0)[1] == 3
    h, made = mutate.merge_edge(g, 1, "L", 2, w=True)
    assert made == 4 and h.edge_count() == 4
    n, first = mutate.merge_edge(g, 1, "L", 2, w=float("nan"))
    assert mutate.merge_edge(n, 1, "L", 2, w=float("nan"))[1] == first + 1


def test_find_page_loose_equality(spark):
    g = PropertyGraph.of(spark, [(["A"], {"x": 1}), (["A"], {"x": 1.0}), (["A"], {"x": True}), (["A"], {"x": "1"}), (["A"], {"x": None}), (["A"], {})])
    ids = lambda where: [n.id for n in g.find_page(where)["nodes"]]
    assert ids({"x": 1}) == [1, 2, 3]
    assert ids({"x": None}) == [5, 6]
    assert ids({"x": "1"}) == [4]
    page = g.find_page({}, "A", 0, 2)
    assert page["next_cursor"] == 2 and g.find_page({}, "A", 4, 2)["next_cursor"] == 6 and g.find_page({}, "A", 6, 2)["next_cursor"] is None


def test_dangling(spark):
    g = PropertyGraph.of(spark, [([], {})], [(1, "L", 2, {}), (3, "L", 1, {})])
    assert sorted(tuple(r) for r in subgraph.dangling(g).collect()) == [(1, "dst"), (2, "src")]


def test_mermaid(people):
    text = subgraph.mermaid(people.nodes.filter("id = 4"), people.edges.filter(F.lit(False)))
    assert text == 'graph LR\n    N4["Company:Acme"]'


def test_numbered_is_dense_and_ordered(spark):
    rows = subgraph.numbered(spark.range(0, 5000, 1, 7).select((F.col("id") * 3).alias("id")), ["id"]).orderBy("id").collect()
    assert [r["new_id"] for r in rows] == list(range(1, 5001))
