"""Registered queries that go through whole interfaces: stores, files, the command line, tools, single writes.

Their results are small or are tables of the commerce graph; what a call gives
to the driver is turned into rows again, so that SQL can be held against it.
"""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from latticework import errors
from latticework.functions import values as V
from latticework.functions.checkpoints import scratch
from latticework.operators import diff, events, merge, mutate, subgraph, traverse, views
from latticework.operators.graph import Node, PropertyGraph, has_label
from latticework.plans import cli, tools
from latticework.plans.catalog import BFS, DEG, IDEMPOTENT, LABELS, MERGED, PARTIES, RANKED, RULES, START, edges, first_id, frame, labels_text, merged, nodes, query, walked
from latticework.sources import csv_io, json_io
from latticework.sources import tables as T
from latticework.sources.folder import Folder
from latticework.sources.store import GraphStore

NOTHING = "one AS (SELECT 1)"


def table_of(rows: list[tuple], columns: str) -> str:
    """SQL of a fixed result."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({columns})"


def small(s, d) -> PropertyGraph:
    """Regions and nations."""
    return PropertyGraph(nodes(s, d, "Region", "Nation"), edges(s, d, "PART_OF"))


def named(df):
    return df.select("id", labels_text(), V.prop_str("name").alias("name"))


# point reads and the query builder
@query("info", "SELECT '1.0' AS version, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, CAST(0 AS BIGINT) AS file_size")
def _(s, d):
    i = T.commerce(s, d).info()
    return frame(s, [tuple(i.values())], "version string, node_count long, edge_count long, file_size long")


@query("record_objects", "SELECT id, (SELECT string_agg(k, ',' ORDER BY k) FROM (VALUES ('name')) t(k)) AS keys, name AS got, TRUE AS has_name, FALSE AS has_other, 'none' AS missing FROM nodes WHERE kind IN ('Region', 'Nation')")
def _(s, d):
    """The object view of nodes: keys, get, [], in."""
    found = map(Node.of, small(s, d).all_nodes().collect())
    return frame(s, [(n.id, ",".join(sorted(n.keys())), n["name"], "name" in n, "other" in n, n.get("other", "none")) for n in found], "id long, keys string, got string, has_name boolean, has_other boolean, missing string")


@query("where_callback", "SELECT id FROM nodes WHERE kind = 'Part' AND size % 5 = 0 AND brand LIKE '%1' ORDER BY id OFFSET 3")
def _(s, d):
    """A Python callback as the predicate, with a later one replacing an earlier one."""
    q = T.commerce(s, d).query_nodes().label("Part").where_(lambda n: False).where_(lambda n: n["size"] % 5 == 0 and n["brand"].endswith("1"))
    return q.skip(3).dataframe().select("id")


@query("fetch_nodes", "SELECT id, name FROM nodes WHERE kind IN ('Region', 'Nation') ORDER BY id LIMIT 20 OFFSET 2")
def _(s, d):
    found = T.commerce(s, d).query_nodes().label("Region").label("Nation").skip(2).limit(20).fetch()
    return frame(s, [(n.id, n["name"]) for n in found], "id long, name string")


@query("builder_is_immutable", "SELECT (SELECT count(*) FROM nodes) AS everything, (SELECT count(*) FROM nodes WHERE kind = 'Part') AS parts, (SELECT count(*) FROM nodes WHERE kind = 'Part') - 5 AS later")
def _(s, d):
    base = T.commerce(s, d).query_nodes()
    parts = base.label("Part")
    later = parts.skip(5)
    return frame(s, [(base.count(), parts.count(), later.count())], "everything long, parts long, later long")


@query("find_nested", "SELECT id FROM nodes WHERE kind = 'Part' AND size IN (7, 1)")
def _(s, d):
    """Lists and maps compare loosely inside: 7 equals 7.0, and true equals 1."""
    parts = nodes(s, d, "Part")
    tag = F.struct(F.lit("list").alias("t"), F.concat(F.lit('[["int","'), V.prop("size")["v"], F.lit('"],["map",{"brand":["str","x"]}]]')).alias("v"))
    g = PropertyGraph(parts.withColumn("props", F.create_map(F.lit("tags"), tag)), edges(s, d, "PART_OF"))
    seven, one = ([x["id"] for x in g.query_nodes().rows.filter(V.loose_key(V.prop("tags")) == V.loose_key(V.value_lit([v, {"brand": "x"}]))).collect()] for v in (7.0, True))
    return frame(s, [(i,) for i in seven + one], "id long")


@query("find_tool", "SELECT id, name, (SELECT 4 + count(*) FROM (SELECT id FROM nodes WHERE kind = 'Customer' AND segment = 'BUILDING' ORDER BY id LIMIT 7 OFFSET 4)) AS next_cursor FROM nodes WHERE kind = 'Customer' AND segment = 'BUILDING' ORDER BY id LIMIT 7 OFFSET 4")
def _(s, d):
    page = tools.find(T.commerce(s, d), {"segment": "BUILDING", "unknown": None}, "Customer", 4, 7)
    return frame(s, [(n["id"], n["name"], page["next_cursor"]) for n in page["nodes"]], "id long, name string, next_cursor long")


@query("find_file", "SELECT min(page_id) AS id, min(url) AS path FROM pages WHERE url = (SELECT min(url) FROM pages)", NOTHING)
def _(s, d):
    pages = T.read(s, d, "pages")
    files = pages.select(F.col("page_id").alias("id"), F.array(F.lit("File")).alias("labels"), V.typed_props({"path": ("str", F.col("url"))}).alias("props"))
    g = PropertyGraph(files.unionByName(nodes(s, d, "Region")), edges(s, d, "PART_OF"))
    found = g.find_file(pages.agg(F.min("url")).first()[0])
    return frame(s, [(found.id, found["path"])], "id long, path string")


# sources
def csv_of(s, d):
    """Nation and party nodes as one CSV folder, and where they live as another."""
    g = T.party_left(s, d)
    at = scratch(s, "csv")
    csv_io.write_nodes(g.nodes, f"{at}/nodes")
    g.edges.orderBy("id").select(F.col("src").alias("from_id"), "label", F.col("dst").alias("to_id"), F.lit("2020").alias("since")).write.csv(f"{at}/edges", header=True)
    return f"{at}/nodes", f"{at}/edges"


NUMBERED = ", n AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM nodes WHERE kind IN ('Nation', 'Customer', 'Supplier'))"


@query("csv_import_nodes", NUMBERED + f" SELECT CAST(id AS VARCHAR) AS ext_id, k AS id, {LABELS} AS labels, name, acctbal, segment FROM n")
def _(s, d):
    got = csv_io.read_nodes(s, csv_of(s, d)[0])
    return got.select("ext_id", "id", labels_text(), V.prop_str("name").alias("name"), V.prop_float("acctbal").alias("acctbal"), V.prop_str("segment").alias("segment"))


@query("csv_import_edges", NUMBERED + " SELECT row_number() OVER (ORDER BY e.id) AS id, a.k AS src, b.k AS dst, label, CAST(2020 AS BIGINT) AS since FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst")
def _(s, d):
    g = csv_io.read_graph(s, *csv_of(s, d))
    return g.edges.select("id", "src", "dst", "label", V.prop_int("since").alias("since"))


@query("csv_export_nodes", f"SELECT CAST(id AS VARCHAR) AS id, replace({LABELS}, ',', '|') AS labels, CAST(acctbal AS VARCHAR) AS acctbal, name, segment FROM nodes WHERE kind IN ('Nation', 'Customer', 'Supplier')")
def _(s, d):
    return s.read.csv(csv_of(s, d)[0], header=True)


@query("csv_export_edges", "SELECT CAST(id AS VARCHAR) AS id, label, CAST(src AS VARCHAR) AS from_node, CAST(dst AS VARCHAR) AS to_node, CASE WHEN label = 'CONTAINS' THEN CAST(l_quantity AS VARCHAR) END AS quantity FROM edges LEFT JOIN lines ON id = 500000000000000 + line")
def _(s, d):
    at = scratch(s, "csv")
    csv_io.write_edges(edges(s, d), at)
    return s.read.csv(at, header=True)


@query("csv_cells", table_of([("1", "int", "1"), (" 5", "int", "5"), ("1_000", "int", "1000"), ("12d", "str", "12d"), ("3F", "str", "3F"), ("2.50", "float", "2.5"), (".5", "float", "0.5"), ("TRUE", "bool", "true"), ("0x1", "str", "0x1")], "cell, kind, value"), NOTHING)
def _(s, d):
    rows = s.createDataFrame([(c,) for c in ("1", " 5", "1_000", "12d", "3F", "2.50", ".5", "TRUE", "0x1")], "cell string").withColumn("x", csv_io.coerced(F.col("cell")))
    return rows.select("cell", F.col("x.t").alias("kind"), F.col("x.v").alias("value"))


def fixture_files(s, d) -> str:
    """Regions and nations as files of named graphs."""
    at, g = scratch(s, "fixture"), small(s, d)
    order = lambda c: F.row_number().over(Window.orderBy(c)).cast("string")  # noqa: E731  thirty rows
    props = F.concat(F.lit('{"name": "'), V.prop_str("name"), F.lit('", "size": 3}'))
    n = g.nodes.select(F.lit("g").alias("graph"), order("id").alias("order"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("ref"), F.array_join("labels", ";").alias("labels"), props.alias("properties_json"))
    n.union(n.withColumn("graph", F.lit("other"))).write.csv(f"{at}/nodes", header=True, quote='"', escape='"')
    ref = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    e = g.edges.select(F.lit("g").alias("graph"), order("id").alias("order"), ref("src").alias("from_ref"), "label", ref("dst").alias("to_ref"), F.lit("{}").alias("properties_json"))
    e.write.csv(f"{at}/edges", header=True, quote='"', escape='"')
    return at


PLACED = ", n AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM nodes WHERE kind IN ('Region', 'Nation'))"


@query("named_graph_nodes", PLACED + " SELECT k AS id, kind AS labels, name, CAST(3 AS BIGINT) AS size FROM n")
def _(s, d):
    at = fixture_files(s, d)
    return csv_io.read_named_graph(s, f"{at}/nodes", f"{at}/edges", "g").nodes.select("id", labels_text(), V.prop_str("name").alias("name"), V.prop_int("size").alias("size"))


EDGES_PLACED = PLACED + " SELECT row_number() OVER (ORDER BY e.id) AS id, a.k AS src, b.k AS dst, label FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst"


@query("named_graph_edges", EDGES_PLACED)
def _(s, d):
    at = fixture_files(s, d)
    return csv_io.read_named_graph(s, f"{at}/nodes", f"{at}/edges", "g").edges.select("id", "src", "dst", "label")


@query("json_import_nodes", PLACED + " SELECT k AS id, kind AS labels, name FROM n")
def _(s, d):
    return named(json_io.import_json(s, json_io.export_json(small(s, d))).nodes)


@query("json_import_edges", EDGES_PLACED)
def _(s, d):
    return json_io.import_json(s, json_io.export_json(small(s, d))).edges.select("id", "src", "dst", "label")


@query("json_import_document", NUMBERED + " SELECT row_number() OVER (ORDER BY e.id) AS id, a.k AS src, b.k AS dst, label, a.name, a.acctbal FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst")
def _(s, d):
    """Nations and parties written to a file and read from it on the executors."""
    file = f"{scratch(s, 'document')}/parties.json"
    json_io.save(s, json_io.document_parts(T.party_left(s, d), "export_version"), file)
    g = json_io.import_document(s, file)
    source = g.nodes.select(F.col("id").alias("src"), V.prop_str("name").alias("name"), V.prop_float("acctbal").alias("acctbal"))
    return g.edges.select("id", "src", "dst", "label").join(source, "src")


@query("json_bulk_import", ", n AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS k FROM nodes WHERE kind IN ('Region', 'Nation')) SELECT k AS id, name FROM n")
def _(s, d):
    """In file order, here from the last to the first."""
    data = json.loads(json_io.plain_json(small(s, d)))
    data["nodes"].reverse()
    return json_io.bulk_json(s, json.dumps(data)).nodes.select("id", V.prop_str("name").alias("name"))


@query("lines_round_trip", "SELECT id, CASE kind WHEN 'Customer' THEN 'Customer,Party' WHEN 'Supplier' THEN 'Party,Supplier' ELSE kind END AS labels, name, acctbal FROM nodes")
def _(s, d):
    """Labels come back sorted, as the lines have them."""
    at = scratch(s, "lines")
    json_io.write_lines(T.commerce(s, d), at)
    return json_io.read_lines(s, at).nodes.select("id", labels_text(), V.prop_str("name").alias("name"), V.prop_float("acctbal").alias("acctbal"))


WALKS = """, steps AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS name FROM nation), way AS (
  SELECT r, k, 20000000001 + k AS id FROM steps UNION ALL SELECT n_regionkey, n_nationkey + 0.5, NULL FROM nation WHERE n_nationkey % 4 = 1)"""


@query("navigation_edges", WALKS + " SELECT src, dst FROM (SELECT lag(id) OVER (PARTITION BY r ORDER BY k) AS src, id AS dst FROM way) WHERE src IS NOT NULL AND dst IS NOT NULL")
def _(s, d):
    """A walk over the nations of each region, with a step back after each and an unknown place after some."""
    step = F.concat(F.col("n_name"), F.lit(";<"), F.when(F.col("n_nationkey") % 4 == 1, F.lit(";nowhere")).otherwise(F.lit("")))
    rows = T.read(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", step.alias("step")))).alias("steps"))
    walks = rows.select(F.array_join(F.transform("steps", lambda x: x["step"]), ";").alias("path"))
    return traverse.paths_from_navigation(walks, nodes(s, d, "Nation").select("id", V.prop_str("name").alias("name")))


@query("indexed_edges", "SELECT 20000000001 + n_nationkey AS src, 10000000001 + n_regionkey AS dst, 'IN' AS label FROM nation")
def _(s, d):
    """Ends given as places, counted from 0, in a list of nodes: regions, then nations."""
    listed = small(s, d).nodes.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("pos"))
    regions = T.read(s, d, "region").count()
    rows = T.read(s, d, "nation").select((F.col("n_nationkey") + regions).alias("from_index"), F.col("n_regionkey").alias("to_index"), F.lit("IN").alias("label"))
    return csv_io.read_indexed_edges(rows, listed)


# writes
@query("add_node", f"SELECT id, {LABELS} AS labels, name FROM nodes UNION ALL SELECT (SELECT max(id) FROM nodes) + 1, 'Supplier,New', 'late' UNION ALL SELECT (SELECT max(id) FROM nodes) + 2, '', NULL")
def _(s, d):
    g, _ = mutate.add_nodes(T.commerce(s, d), [(["Supplier", "New"], {"name": "late"}), ([], {})])
    return named(g.nodes)


@query("add_edge", f"SELECT id, src, dst, label FROM edges UNION ALL SELECT (SELECT max(id) FROM edges) + k, {START}, 10000000001, 'VISITS' FROM (VALUES (1), (2)) t(k) UNION ALL SELECT (SELECT max(id) FROM edges) + 3, 10000000001, 10000000001, 'IS'")
def _(s, d):
    """Parallel edges and a loop are new edges of their own."""
    start = first_id(s, d)
    g, _ = mutate.add_edges(T.commerce(s, d), [(start, "VISITS", 10000000001, {}), (start, "VISITS", 10000000001, {}), (10000000001, "IS", 10000000001, {})])
    return g.edges.select("id", "src", "dst", "label")


@query("update_node", "SELECT id, CASE WHEN id = 10000000001 THEN 'changed' ELSE name END AS name, CASE WHEN id = 10000000001 THEN CAST(4 AS BIGINT) END AS extra FROM nodes")
def _(s, d):
    g = mutate.update_node(T.commerce(s, d), 10000000001, name="changed", extra=4)
    return g.nodes.select("id", V.prop_str("name").alias("name"), V.prop_int("extra").alias("extra"))


@query("update_edge", "SELECT id, src, dst, label, CASE WHEN id = 100000000000003 THEN 'old' END AS note FROM edges")
def _(s, d):
    g = mutate.update_edge(T.commerce(s, d), 100000000000003, note="old")
    return g.edges.select("id", "src", "dst", "label", V.prop_str("note").alias("note"))


@query("delete_edge", "SELECT id FROM edges WHERE id <> 100000000000003")
def _(s, d):
    return mutate.delete_edge(T.commerce(s, d), 100000000000003).edges.select("id")


@query("delete_node", "SELECT id, src, dst, label FROM edges WHERE src <> 20000000004 AND dst <> 20000000004")
def _(s, d):
    return mutate.delete_node(T.commerce(s, d), 20000000004).edges.select("id", "src", "dst", "label")


@query("write_errors", table_of([("update_node", "NodeNotFoundError"), ("delete_node", "NodeNotFoundError"), ("add_edge", "NodeNotFoundError"), ("update_edge", "EdgeNotFoundError"), ("delete_edge", "EdgeNotFoundError"), ("out_edges", "NodeNotFoundError"), ("direction", "ValueError"), ("get_node", "None"), ("get_edge", "None")], "action, outcome"), NOTHING)
def _(s, d):
    g = small(s, d)
    tries: dict[str, Callable[[], Any]] = {
        "update_node": lambda: mutate.update_node(g, 5, a=1), "delete_node": lambda: mutate.delete_node(g, 5), "add_edge": lambda: mutate.add_edges(g, [(10000000001, "R", 5, {})]),
        "update_edge": lambda: mutate.update_edge(g, 5, a=1), "delete_edge": lambda: mutate.delete_edge(g, 5), "out_edges": lambda: g.out_edges(5),
        "direction": lambda: g.neighbours(10000000001, direction="up"), "get_node": lambda: g.get_node(0), "get_edge": lambda: g.get_edge(0),
    }
    return frame(s, [(k, outcome(f)) for k, f in tries.items()], "action string, outcome string")


def outcome(f: Callable[[], Any]) -> str:
    """What a call gives, or the name of its error."""
    try:
        return str(f())
    except (errors.GraphError, ValueError) as e:
        return type(e).__name__


# stores
@query("store_round_trip", f"SELECT id, {LABELS} AS labels, name FROM nodes WHERE kind IN ('Nation', 'Customer', 'Supplier')")
def _(s, d):
    """Committed, closed, and read from the folder again."""
    at = scratch(s, "store")
    with GraphStore(s, at) as store:
        store.graph = T.party_left(s, d)
        store.commit()
    again = GraphStore(s, at)
    found = named(again.graph.nodes)
    again.close()
    return found


@query(
    "store_lifecycle",
    table_of([("committed", 2), ("rolled back", 2), ("failed transaction", 2), ("transaction", 3), ("begin", 3), ("vacuum with staged", 4), ("rolled back after vacuum", 4), ("next id", 5), ("repaired", 5), ("cleared", 0), ("first id", 1), ("reopened", 0)], "step, n"),
    NOTHING,
)
def _(s, d):
    at, out = scratch(s, "store"), []
    with GraphStore(s, at) as store:
        store.add_node(["P"], name="a")
        store.add_node(["P"], name="b")
        store.commit()
        out.append(("committed", store.graph.node_count()))
        store.add_node(["P"])
        store.rollback()
        out.append(("rolled back", store.graph.node_count()))
        with contextlib.suppress(RuntimeError), store.transaction():
            store.add_node(["P"])
            raise RuntimeError
        out.append(("failed transaction", store.graph.node_count()))
        with store.transaction():
            store.add_node(["P"])
        out.append(("transaction", store.graph.node_count()))
        store.begin()
        out.append(("begin", store.graph.node_count()))
        store.add_node(["P"])
        store.vacuum()
        out.append(("vacuum with staged", store.graph.node_count()))
        store.rollback()
        out.append(("rolled back after vacuum", store.graph.node_count()))
        out.append(("next id", store.add_node(["P"])))
        out.append(("repaired", store.repair_adjacency()["nodes_rewritten"]))
        store.clear()
        out.append(("cleared", store.graph.node_count()))
        out.append(("first id", store.add_node(["P"])))
    with GraphStore(s, at) as store:
        out.append(("reopened", store.graph.node_count()))
    return frame(s, out, "step string, n long")


@query("store_guards", table_of([("opened twice", "AlreadyOpenError"), ("nested transaction", "TransactionError"), ("vacuum in transaction", "TransactionError"), ("closed twice", "None"), ("used after close", "ValueError")], "attempt, outcome"), NOTHING)
def _(s, d):
    at, out = scratch(s, "store"), []
    store = GraphStore(s, at)
    out.append(("opened twice", outcome(lambda: GraphStore(s, at))))
    with store.transaction():
        out.append(("nested transaction", outcome(lambda: store.transaction().__enter__())))
        out.append(("vacuum in transaction", outcome(store.vacuum)))
    store.close()
    out.append(("closed twice", outcome(store.close)))
    out.append(("used after close", outcome(lambda: store.add_node(["P"]))))
    return frame(s, out, "attempt string, outcome string")


@query("error_kinds", table_of([(n, "GraphError") for n in ("NodeNotFoundError", "EdgeNotFoundError", "CorruptedGraphError", "TransactionError", "MergeError", "AlreadyOpenError", "CapacityExceededError", "UsageError")], "name, base"), NOTHING)
def _(s, d):
    kinds = [x for x in vars(errors).values() if isinstance(x, type) and issubclass(x, errors.GraphError) and x is not errors.GraphError]
    return frame(s, [(x.__name__, x.__base__.__name__) for x in kinds], "name string, base string")


# adjacency and traversal
AROUND = "(SELECT *, CASE WHEN src = 20000000004 THEN 'out' ELSE 'in' END AS side FROM edges WHERE src = 20000000004 OR dst = 20000000004)"


@query("neighbours_of_one", f"SELECT 'out' AS direction, dst AS id, row_number() OVER (ORDER BY id DESC) AS rank FROM {AROUND} WHERE side = 'out' UNION ALL SELECT 'in', src, row_number() OVER (ORDER BY id DESC) FROM {AROUND} WHERE side = 'in' UNION ALL SELECT 'both', CASE side WHEN 'out' THEN dst ELSE src END, row_number() OVER (ORDER BY side DESC, id DESC) FROM {AROUND}")
def _(s, d):
    """A nation has no parallel edges, so ``both`` is one after the other."""
    around = T.commerce_around(s, d, 20000000004).edges
    g = PropertyGraph(nodes(s, d, "Region", "Nation", "Customer", "Supplier"), around)
    parts = [g.neighbours(20000000004, direction=x).select(F.lit(x).alias("direction"), "id", F.col("rank").cast("long").alias("rank")) for x in ("out", "in", "both")]
    return parts[0].union(parts[1]).union(parts[2])


@query("hydrate", "SELECT o_custkey + 30000000001 AS id, c_name AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def _(s, d):
    """Ids from orders, and one that no node has."""
    ids = T.read(s, d, "orders").select((F.col("o_custkey") + 30000000001).alias("node")).union(s.createDataFrame([(7,)], "node long"))
    return T.commerce(s, d).hydrate(ids, "node").groupBy("id", V.prop_str("name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("bfs_tree_nodes", BFS.format(start=START, depth=2) + " SELECT id, depth FROM reached")
def _(s, d):
    return views.bfs_tree(T.commerce(s, d), first_id(s, d), 2)[0]


@query("path_hop_labels", RANKED.format(start=START) + ", goal AS (SELECT id, r FROM c2 WHERE k = 1 AND id = (SELECT min(id) FROM d2)), mid AS (SELECT d1.id FROM d1 JOIN goal ON d1.rank = goal.r), hops AS (SELECT 0 AS pos, (SELECT id FROM d0) AS src, (SELECT id FROM mid) AS dst UNION ALL SELECT 1, (SELECT id FROM mid), (SELECT id FROM goal)) SELECT pos, hops.src, hops.dst, max_by(label, id) AS label FROM hops JOIN edges e ON e.src = hops.src AND e.dst = hops.dst GROUP BY 1, 2, 3")
def _(s, d):
    g = T.commerce(s, d)
    goal = walked(s, d, 2).filter("depth = 2").agg(F.min("id")).first()[0]
    return traverse.hop_labels(g.edges, traverse.shortest_path(g, first_id(s, d), goal))


@query("explore_tool", RANKED.format(start=START) + ", all_ AS (SELECT id, -1 AS depth, 0 AS rank FROM d0 UNION ALL SELECT id, 1, rank FROM d1 UNION ALL SELECT id, 2, rank FROM d2), pos AS (SELECT id, row_number() OVER (ORDER BY depth, rank) AS pos FROM all_) SELECT pos, pos.id, n.name, (SELECT count(*) > 50 FROM pos) AS truncated FROM pos JOIN nodes n ON n.id = pos.id WHERE pos <= 50")
def _(s, d):
    got = tools.explore(T.commerce(s, d), first_id(s, d), 2)
    return frame(s, [(i, n["id"], n.get("name"), got["truncated"]) for i, n in enumerate(got["nodes"], 1)], "pos long, id long, name string, truncated boolean")


HOME = f"home AS (SELECT c_custkey + 30000000001 AS c, c_name, n_nationkey + 20000000001 AS n, n_name, r_regionkey + 10000000001 AS r, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey + 30000000001 = {START})"


@query("trace_tool", f""", {HOME} SELECT 'path' AS part, 0 AS pos, c_name AS text FROM home UNION ALL SELECT 'path', 1, n_name FROM home UNION ALL SELECT 'path', 2, r_name FROM home UNION ALL SELECT 'hop', 0, 'IN_NATION' UNION ALL SELECT 'hop', 1, 'PART_OF'
    UNION ALL SELECT 'branch', row_number() OVER (ORDER BY label, dst) - 1, label || ' ' || dst FROM edges WHERE src = {START}
    UNION ALL SELECT 'mermaid', 0, 'graph LR' UNION ALL SELECT 'mermaid', 1, '    N' || r || '["Region:' || r_name || '"]' FROM home UNION ALL SELECT 'mermaid', 2, '    N' || n || '["Nation:' || n_name || '"]' FROM home UNION ALL SELECT 'mermaid', 3, '    N' || c || '["Party/Customer:' || c_name || '"]' FROM home
    UNION ALL SELECT 'mermaid', 4, '    N' || n || ' -->|PART_OF| N' || r FROM home UNION ALL SELECT 'mermaid', 5, '    N' || c || ' -->|IN_NATION| N' || n FROM home""")
def _(s, d):
    start = first_id(s, d)
    g = T.commerce(s, d)
    goal = walked(s, d, 2).filter("depth = 2 and id < 20000000000").agg(F.min("id")).first()[0]
    t = tools.trace(g, start, goal)
    parts = {"path": [n["name"] for n in t["path"]], "hop": t["path_hop_labels"], "branch": [f"{b['edge_label']} {b['target']['id']}" for b in t["reasoning_branches"]], "mermaid": t["mermaid"].splitlines()}
    return frame(s, [(k, i, x) for k, lines in parts.items() for i, x in enumerate(lines)], "part string, pos long, text string")


STORY = (
    [(["Decision"], {"title": "Cache it", "reason": "fast; safe ;"}), (["Option"], {"title": "Use Redis", "summary": "Known here and quick"}), (["Option"], {"title": "Use files", "rejection_note": " too slow "}), (["Incident"], {"title": "Outage", "key_factor": " the big outage "}), (["Rule"], {}), (["File"], {"title": "t", "path": "cache.py"})],
    [(1, "CONSIDERED", 2, {}), (1, "CONSIDERED", 3, {}), (1, "LEARNED_FROM", 4, {}), (1, "CONSTRAINED_BY", 5, {}), (2, "DONE_IN", 6, {})],
)
STORY_TEXT = ["Trace: Cache it → cache.py", "", "Decision found:", "Cache it", "", "Why:", "  ✓ fast", "  ✓ safe", "", "Key factors:", "  ✓ the big outage", "  ✓ Rule #5", "  ✓ Known here", "", "Rejected:", "  ✗ files (too slow)", "", "Implemented in:", "  cache.py", "", "Path:", "  Cache it", "  → Use Redis", "  → cache.py"]


@query("trace_text", table_of([(i, "Trace: Cache it → t" if i == 0 else x) for i, x in enumerate(STORY_TEXT)], "pos, line"), NOTHING)
def _(s, d):
    text = tools.trace_text(tools.trace(PropertyGraph.of(s, *STORY), 1, 6), mermaid=False)
    return frame(s, list(enumerate(text.splitlines())), "pos long, line string")


@query("hop_comparison", "SELECT s_suppkey * 100 + r_regionkey AS walk, 2 + s_suppkey % 3 AS hops, CASE WHEN r_regionkey = n_regionkey THEN 2 END AS shortest, CASE WHEN r_regionkey = n_regionkey THEN s_suppkey % 3 END AS overhead FROM supplier JOIN nation ON n_nationkey = s_nationkey CROSS JOIN region")
def _(s, d):
    """A walk from each supplier to each region; most regions cannot be reached."""
    regions = F.broadcast(T.read(s, d, "region").select("r_regionkey"))  # five rows
    walks = T.read(s, d, "supplier").crossJoin(regions).select((F.col("s_suppkey") * 100 + F.col("r_regionkey")).alias("walk"), (F.col("s_suppkey") + 40000000001).alias("start"), (F.col("r_regionkey") + 10000000001).alias("goal"), (2 + F.col("s_suppkey") % 3).alias("hops"))
    return views.hop_comparison(walks, edges(s, d), 4)


@query("context_packet", ", c AS (SELECT * FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)) SELECT string_agg('  - Turn: ' || coalesce(text, ''), chr(10) ORDER BY turn DESC) AS text FROM c")
def _(s, d):
    first = T.read(s, d, "conversations").agg(F.min("conv_id")).first()[0]
    return frame(s, [(tools.context_packet(T.conversation_graph(s, d), 10000000001 + first, 2),)], "text string")


@query("simple_cycles", ", links AS (SELECT DISTINCT a.c_nationkey AS src, s_nationkey AS dst FROM customer a JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey) SELECT CAST(src AS VARCHAR) AS cycle FROM links WHERE src = dst UNION ALL SELECT a.src || '>' || a.dst FROM links a JOIN links b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.src || '>' || b.src || '>' || c.src FROM links a JOIN links b ON b.src = a.dst JOIN links c ON c.src = b.dst AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src")
def _(s, d):
    """Trade between nations: a customer's buys from a supplier's."""
    c, o, i, p = (T.read(s, d, x) for x in ("customer", "orders", "lineitem", "supplier"))
    bought = c.join(o, c["c_custkey"] == o["o_custkey"]).join(i, o["o_orderkey"] == i["l_orderkey"]).join(p, i["l_suppkey"] == p["s_suppkey"])
    found = traverse.simple_cycles(bought.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")), 3)
    return found.select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


# figures and views
@query("stats_tool", f"SELECT 'node' AS kind, label, n FROM (SELECT kind AS label, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'Party', count(*) FROM nodes WHERE kind IN ('Customer', 'Supplier')) UNION ALL SELECT 'edge', label, count(*) FROM edges GROUP BY label UNION ALL SELECT 'count', 'nodes', count(*) FROM nodes UNION ALL SELECT 'count', 'edges', count(*) FROM edges")
def _(s, d):
    t = tools.stats(T.commerce(s, d))
    rows = [("node", k, n) for k, n in t["node_labels"].items()] + [("edge", k, n) for k, n in t["edge_labels"].items()] + [("count", "nodes", t["node_count"]), ("count", "edges", t["edge_count"])]
    return frame(s, rows, "kind string, label string, n long")


@query("overview_tool", f"SELECT d.id, out_degree + in_degree AS degree, n.kind FROM {DEG} d JOIN nodes n ON n.id = d.id ORDER BY degree DESC, d.id LIMIT 5")
def _(s, d):
    return frame(s, [(n["id"], n["degree"], n["labels"][-1]) for n in tools.overview(T.commerce(s, d))["samples"]], "id long, degree long, kind string")


@query("typed_view", "SELECT id, size, price AS retailprice, brand FROM nodes WHERE kind = 'Part'")
def _(s, d):
    return views.typed_view(nodes(s, d), "Part", ints=["size"], floats=["retailprice"], strings=["brand"])


@query("simple_digraph", "SELECT src, dst, max(id) AS id, max_by(label, id) AS label FROM edges GROUP BY src, dst")
def _(s, d):
    return views.simple_digraph(edges(s, d)).select("src", "dst", "id", "label")


@query("missing_keys", "SELECT id, 'Part' AS label, 'color' AS key FROM nodes WHERE kind = 'Part' UNION ALL SELECT id, 'Party', 'segment' FROM nodes WHERE kind = 'Supplier'")
def _(s, d):
    return views.missing_keys(nodes(s, d), {"Part": ["size", "color"], "Party": ["name", "segment"]})


SMALL_MAP = "SELECT 0 AS pos, 'graph LR' AS line UNION ALL SELECT row_number() OVER (ORDER BY id), '    N' || id || '[\"' || kind || ':' || name || '\"]' FROM nodes WHERE kind IN ('Region', 'Nation') UNION ALL SELECT (SELECT count(*) FROM nodes WHERE kind IN ('Region', 'Nation')) + row_number() OVER (ORDER BY id), '    N' || src || ' -->|PART_OF| N' || dst FROM edges WHERE label = 'PART_OF'"


@query("map_tool", SMALL_MAP)
def _(s, d):
    """Of the whole graph the nodes first by id, 30 by default: regions and nations."""
    lines = tools.map_tool(T.commerce(s, d))["mermaid"].splitlines()
    return frame(s, list(enumerate(lines)), "pos long, line string")


@query("viewer_summary", ", shown AS (SELECT id, coalesce(name, 'node:' || id) AS text FROM nodes ORDER BY id LIMIT 300) SELECT 'label' AS part, label AS name, n FROM (SELECT kind AS label, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'Party', count(*) FROM nodes WHERE kind IN ('Customer', 'Supplier')) UNION ALL SELECT 'node', text, id FROM shown UNION ALL SELECT 'edge', src || ' ' || label || ' ' || dst, 0 FROM (SELECT * FROM edges WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown) ORDER BY id LIMIT 600)")
def _(s, d):
    v = subgraph.viewer_summary(T.commerce(s, d))
    rows = [("label", k, n) for k, n in v["labels"].items()] + [("node", t, i) for i, t in v["nodes"]] + [("edge", f"{a} {label} {b}", 0) for a, label, b in v["edges"]]
    return frame(s, rows, "part string, name string, n long")


# documents
def document_sql(kind: str) -> str:
    """The exchange document of regions and nations, as text."""
    q = lambda x: "'" + x + "'"
    edge = "'    {' || chr(10) || '      \"from_node\": ' || src || ',' || chr(10) || '      \"id\": ' || id || ',' || chr(10) || '      \"label\": \"' || label || '\",' || chr(10) || '      \"properties\": {},' || chr(10) || '      \"to_node\": ' || dst || chr(10) || '    }'"
    node = "'    {' || chr(10) || '      \"id\": ' || id || ',' || chr(10) || '      \"labels\": [' || chr(10) || '        \"' || kind || '\"' || chr(10) || '      ],' || chr(10) || '      \"properties\": {' || chr(10) || '        \"name\": \"' || name || '\"' || chr(10) || '      }' || chr(10) || '    }'"
    fields = {
        "edge_count": "(SELECT count(*) FROM e)", "edges": f"'[' || chr(10) || (SELECT string_agg({edge}, ',' || chr(10) ORDER BY id) FROM e) || chr(10) || '  ]'",
        kind: q("1"), "format_version": q('"1.0"'), "node_count": "(SELECT count(*) FROM n)",
        "nodes": f"'[' || chr(10) || (SELECT string_agg({node}, ',' || chr(10) ORDER BY id) FROM n) || chr(10) || '  ]'",
    }
    body = " || ',' || chr(10) || ".join(f"'  \"{k}\": ' || {fields[k]}" for k in sorted(fields))
    return f", e AS (SELECT * FROM edges WHERE label = 'PART_OF'), n AS (SELECT * FROM nodes WHERE kind IN ('Region', 'Nation')), doc AS (SELECT '{{' || chr(10) || {body} || chr(10) || '}}' || chr(10) AS text)"


@query("export_document", document_sql("export_version") + " SELECT text FROM doc")
def _(s, d):
    return frame(s, [(json_io.export_json(small(s, d)),)], "text string")


@query("manifest_document", document_sql("manifest_version") + " SELECT text FROM doc")
def _(s, d):
    return frame(s, [(json_io.manifest(small(s, d)),)], "text string")


KEY = b"a key of the test"
PADS = ["".join(f"{b ^ pad:02x}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("signature", document_sql("manifest_version") + f" SELECT sha256(text) AS sha256, sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(text)))) AS signature, 'HMAC-SHA256' AS algorithm, '1.0' AS format_version FROM doc")
def _(s, d):
    signed = json_io.sign(small(s, d), KEY)
    return frame(s, [tuple(signed[k] for k in ("sha256", "signature", "algorithm", "format_version"))], "sha256 string, signature string, algorithm string, format_version string")


@query("verification", table_of([("same", True, True, True, True), ("other key", True, True, False, False), ("other graph", True, False, False, False), ("other version", False, True, True, False)], "attempt, compatible, digest, signature, valid"), NOTHING)
def _(s, d):
    g = small(s, d)
    signed = json_io.sign(g, KEY)
    tries = {"same": (g, KEY, signed), "other key": (g, b"x", signed), "other graph": (mutate.delete_edge(g, 100000000000003), KEY, signed), "other version": (g, KEY, signed | {"format_version": "9"})}
    return frame(s, [(k, *(json_io.verify(*x)[c] for c in ("compatible", "digest", "signature", "valid"))) for k, x in tries.items()], "attempt string, compatible boolean, digest boolean, signature boolean, valid boolean")


@query("plain_document", ", n AS (SELECT * FROM nodes WHERE kind IN ('Region', 'Nation')) SELECT 'node' AS part, id, kind AS label, name, CAST(NULL AS BIGINT) AS from_node, CAST(NULL AS BIGINT) AS to_node FROM n UNION ALL SELECT 'edge', id, label, NULL, src, dst FROM edges WHERE label = 'PART_OF'")
def _(s, d):
    data = json.loads(json_io.plain_json(small(s, d)))
    rows = [("node", n["id"], n["labels"][0], n["properties"]["name"], None, None) for n in data["nodes"]] + [("edge", e["id"], e["label"], None, e["from_node"], e["to_node"]) for e in data["edges"]]
    return frame(s, rows, "part string, id long, label string, name string, from_node long, to_node long")


# diff
WHOLE_RIGHT = """, rk AS (SELECT id, kind, name, acctbal, price, CASE WHEN (id - 1) % 11 = 5 THEN 'changed' END AS flag FROM nodes WHERE (id - 1) % 7 <> 3 OR kind IN ('Region', 'Nation')),
re AS (SELECT id, src, dst, CASE WHEN id % 17 = 4 THEN 'WAS_' || label ELSE label END AS label FROM edges WHERE id % 13 <> 2)"""


def whole_right(s, d) -> PropertyGraph:
    """The commerce graph with nodes and edges gone or changed by rule."""
    g = T.commerce(s, d)
    key = F.col("id") - 1
    kept = g.nodes.filter((key % 7 != 3) | has_label(["Region", "Nation"]))
    changed = kept.withColumn("props", F.when(key % 11 == 5, V.overlay(F.col("props"), V.props_lit({"flag": "changed"}))).otherwise(F.col("props")))
    left = g.edges.filter("id % 13 <> 2").withColumn("label", F.when(F.col("id") % 17 == 4, F.concat(F.lit("WAS_"), "label")).otherwise(F.col("label")))
    return PropertyGraph(changed, left)


@query("diff_all_nodes", WHOLE_RIGHT + " SELECT l.id, CASE WHEN r.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM nodes l LEFT JOIN rk r ON r.id = l.id WHERE r.id IS NULL OR r.flag IS NOT NULL")
def _(s, d):
    return diff.diff_nodes_by_id(nodes(s, d), whole_right(s, d).nodes)


@query("diff_all_edges", WHOLE_RIGHT + " SELECT l.id, CASE WHEN r.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM edges l LEFT JOIN re r ON r.id = l.id WHERE r.id IS NULL OR r.label <> l.label")
def _(s, d):
    return diff.diff_edges_by_id(edges(s, d), whole_right(s, d).edges)


@query("diff_nested", table_of([(2, "changed"), (3, "removed"), (4, "added"), (5, "changed")], "id, change"), NOTHING)
def _(s, d):
    """Lists and maps are the same where their numbers are; labels in any order."""
    make = lambda rows: s.createDataFrame([(i, list(labels), V.encode_props(p)) for i, labels, p in rows], V.NODE_SCHEMA)
    left = make([(1, "ab", {"x": [1, {"y": True}]}), (2, "a", {"x": [1]}), (3, "a", {}), (5, "a", {})])
    right = make([(1, "ba", {"x": [1.0, {"y": 1}]}), (2, "a", {"x": ["1"]}), (4, "a", {}), (5, "a", {"x": None})])
    return diff.diff_nodes_by_id(left, right)


@query("diff_report", "SELECT 'nodes' AS part, 'added' AS change, count(*) AS n FROM rn WHERE id NOT IN (SELECT id FROM ln) UNION ALL SELECT 'nodes', 'removed', count(*) FROM ln WHERE id NOT IN (SELECT id FROM rn) UNION ALL SELECT 'nodes', 'changed', count(*) FROM ln l JOIN rn r ON l.id = r.id WHERE r.flag IS NOT NULL UNION ALL SELECT 'edges', 'added', count(*) FROM re WHERE id NOT IN (SELECT id FROM le) UNION ALL SELECT 'edges', 'removed', count(*) FROM le WHERE id NOT IN (SELECT id FROM re) UNION ALL SELECT 'edges', 'changed', count(*) FROM le l JOIN re r ON l.id = r.id WHERE l.label <> r.label UNION ALL SELECT 'left', 'nodes', count(*) FROM ln UNION ALL SELECT 'right', 'edges', count(*) FROM re", PARTIES)
def _(s, d):
    r = diff.diff(T.party_left(s, d), T.party_right(s, d))
    rows = [(k, c, len(r[k][c])) for k in ("nodes", "edges") for c in ("added", "removed", "changed")]
    return frame(s, [*rows, ("left", "nodes", r["left"]["node_count"]), ("right", "edges", r["right"]["edge_count"])], "part string, change string, n long")


SOME = "SELECT 'Nodes: +0 -1 ~1' AS line, 0 AS pos UNION ALL SELECT '  - name=''' || name || '''', 1 FROM nodes WHERE id = 20000000003 UNION ALL SELECT '  ~ name=''' || name || '''', 2 FROM nodes WHERE id = 20000000002 UNION ALL SELECT 'Edges: +0 -1 ~0', 3 UNION ALL SELECT '  - name=''' || a.name || ''' -[PART_OF]-> name=''' || b.name || '''', 4 FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src = 20000000003"


@query("diff_text", SOME)
def _(s, d):
    g = small(s, d)
    other = mutate.update_node(mutate.delete_node(g, 20000000003), 20000000002, note="x")
    return frame(s, [(x, i) for i, x in enumerate(diff.format_text(diff.diff(g, other, ["name"])).splitlines())], "line string, pos int")


@query("identity_rules_file", "SELECT id, kind || ':name=''' || name || '''' AS identity FROM nodes WHERE kind IN ('Nation', 'Customer', 'Supplier')")
def _(s, d):
    at = Folder(s, scratch(s, "rules"))
    at.write("rules.json", json.dumps({"identity_rules": RULES}))
    return diff.identities(T.party_left(s, d).nodes, None, cli.rules_of(s, f"{at.path}/rules.json"))


@query("identity_errors", table_of([("no value", "UsageError"), ("not unique", "UsageError"), ("no rule", "UsageError"), ("both", "UsageError"), ("broken rules", "UsageError")], "attempt, outcome"), NOTHING)
def _(s, d):
    g, at = small(s, d), Folder(s, scratch(s, "rules"))
    at.write("rules.json", '{"identity_rules": {"A": "name"}}')
    twice = mutate.add_nodes(g, [(["Region"], {"name": "ASIA"}), (["Region"], {"name": "ASIA"})])[0]
    tries = {"no value": lambda: diff.diff(g, g, ["size"]), "not unique": lambda: diff.diff(twice, g, ["name"]), "no rule": lambda: diff.diff(g, g, rules={"Nation": ["name"]}), "both": lambda: diff.diff(g, g, ["name"], {"Nation": ["name"]}), "broken rules": lambda: cli.rules_of(s, f"{at.path}/rules.json")}
    return frame(s, [(k, outcome(f)) for k, f in tries.items()], "attempt string, outcome string")


# merge
@query("merge_labels", MERGED + f" SELECT l.id, {LABELS.replace('kind', 'l.kind')} AS labels FROM ln l UNION ALL SELECT new_id, 'Other' FROM fresh", PARTIES)
def _(s, d):
    """Labels of a reused node stay; a new one brings its own."""
    right = T.party_right(s, d)
    other = PropertyGraph(right.nodes.withColumn("labels", F.array(F.lit("Other"))), right.edges)
    return merge.merge_from(T.party_left(s, d), other, ["name"], on_node_conflict="overwrite_from_src").graph.nodes.select("id", labels_text())


@query("merge_errors", table_of([("itself", "ValueError"), ("no key", "MergeError"), ("missing key", "MergeError"), ("strategy", "ValueError"), ("mode", "ValueError")], "attempt, outcome"), NOTHING)
def _(s, d):
    a, b = small(s, d), small(s, d)
    tries = {"itself": lambda: merge.merge_from(a, a), "no key": lambda: merge.merge_from(a, b, []), "missing key": lambda: merge.merge_from(a, b, ["size"]), "strategy": lambda: merge.merge_from(a, b, edge_strategy="x"), "mode": lambda: merge.merge_from(a, b, on_node_conflict="x")}
    return frame(s, [(k, outcome(f)) for k, f in tries.items()], "attempt string, outcome string")


@query("merge_preview", IDEMPOTENT + " SELECT TRUE AS can_merge, (SELECT count(*) FROM map WHERE created) AS nodes_created, (SELECT count(*) FROM map WHERE NOT created) AS nodes_reused, (SELECT count(*) FROM made) AS edges_created, (SELECT count(*) FROM moved) - (SELECT count(*) FROM made) AS edges_reused, (SELECT count(*) FROM rn r JOIN ln l ON l.name = r.name WHERE l.acctbal <> r.acctbal) AS warnings, CAST(0 AS BIGINT) AS conflicts", PARTIES)
def _(s, d):
    p = merge.preview(T.party_left(s, d), T.party_right(s, d), ["name"], edge_strategy="idempotent")
    return frame(s, [(p["can_merge"], *p["report"].values(), len(p["warnings"]), len(p["conflicts"]))], "can_merge boolean, nodes_created long, nodes_reused long, edges_created long, edges_reused long, warnings long, conflicts long")


@query("merge_preview_blocked", "SELECT FALSE AS can_merge, CAST(0 AS BIGINT) AS created, (SELECT count(*) FROM rn WHERE segment IS NULL) + 2 * (SELECT count(*) FROM (SELECT segment FROM ln GROUP BY 1 HAVING count(*) > 1 AND segment IS NOT NULL)) + (SELECT count(*) FROM (SELECT segment FROM rn GROUP BY 1 HAVING count(*) > 1 AND segment IS NOT NULL)) AS conflicts", PARTIES)
def _(s, d):
    p = merge.preview(T.party_left(s, d), T.party_right(s, d), ["segment"])
    return frame(s, [(p["can_merge"], sum(p["report"].values()), len(p["conflicts"]))], "can_merge boolean, created long, conflicts long")


@query("rule_conflicts", "SELECT 'unmatched_identity_rule' AS type, 'source' AS side, count(*) AS n FROM rn WHERE kind = 'Nation' UNION ALL SELECT 'multiple_identity_rules', 'source', count(*) FROM rn WHERE kind = 'Customer' UNION ALL SELECT 'multiple_identity_rules', 'destination', count(*) FROM ln WHERE kind = 'Customer' UNION ALL SELECT 'missing_identity_rule_key', 'source', count(*) FROM rn WHERE kind = 'Supplier' AND flag IS NULL UNION ALL SELECT 'missing_identity_rule_key', 'destination', count(*) FROM ln WHERE kind = 'Supplier' UNION ALL SELECT 'duplicate_identity_rule', 'source', 1 WHERE (SELECT count(*) FROM rn WHERE kind = 'Supplier' AND flag IS NOT NULL) > 1", PARTIES)
def _(s, d):
    found = merge.rule_conflicts(T.party_left(s, d).nodes, T.party_right(s, d).nodes, {"Customer": ["name"], "Party": ["flag"]})
    counted = found.groupBy("type", "side").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 0")


@query("merge_label_warnings", "SELECT 'node_label_difference' AS type, r.id AS src_id, l.id AS dst_id, replace(CASE l.kind WHEN 'Customer' THEN 'Customer,Party' WHEN 'Supplier' THEN 'Party,Supplier' ELSE l.kind END, ' ', '') AS dst_value, 'Other' AS src_value FROM rn r JOIN ln l ON l.name = r.name", PARTIES)
def _(s, d):
    left, right = T.party_left(s, d), T.party_right(s, d)
    other = right.nodes.withColumn("labels", F.array(F.lit("Other")))
    pairs = merge.merge_from(left, PropertyGraph(other, right.edges), ["name"]).node_map.filter("not created")
    return merge.warnings(left.nodes, other, pairs).filter("type = 'node_label_difference'").select("type", "src_id", "dst_id", "dst_value", "src_value")


@query("merge_text", "SELECT 0 AS pos, 'Merge preview' AS line UNION ALL SELECT 1, 'Can merge: yes' UNION ALL SELECT 2, 'Nodes: 0 created, ' || count(*) || ' reused' FROM nodes WHERE kind IN ('Region', 'Nation') UNION ALL SELECT 3, 'Edges: 0 created, ' || count(*) || ' reused' FROM edges WHERE label = 'PART_OF' UNION ALL SELECT 4, 'Conflicts: 0' UNION ALL SELECT 5, 'Warnings: 0'")
def _(s, d):
    text = merge.format_text(merge.preview(small(s, d), small(s, d), ["name"], edge_strategy="idempotent"))
    return frame(s, list(enumerate(text.splitlines())), "pos int, line string")


# event log
@query("append_event", table_of([("event:000001", "start", "ann"), ("event:000002", "stop", "ann"), ("event:000009", "note", "bob"), ("event:000010", "late", "bob"), ("event:000009 again", "ValueError", None), ("AUTHORED", "4", None), ("CAUSED_BY", "1", None), ("CITES", "1", None), ("actors", "2", None)], "what, value, actor"), NOTHING)
def _(s, d):
    g, _ids = mutate.add_nodes(PropertyGraph.empty(s), [(["Source"], {"key": "book"})])
    g, first = events.append_event(g, "ann", "start", timestamp="2024-01-01T00:00:00Z")
    g, _second = events.append_event(g, "ann", "stop", timestamp="2024-01-02T00:00:00Z", caused_by=first, cites="nothing")
    g, _third = events.append_event(g, "bob", "note", event_id="event:000009", timestamp="2024-01-03T00:00:00Z", caused_by="nothing", cites="book")
    g, _fourth = events.append_event(g, "bob", "late", timestamp="2024-01-04T00:00:00Z", parent_event_id="not checked")
    names = {x["id"]: x["key"] for x in g.nodes.filter(has_label(["Actor"])).select("id", V.prop_str("key").alias("key")).collect()}
    by = {x["dst"]: names[x["src"]] for x in g.edges.filter("label = 'AUTHORED'").collect()}
    ids = {x["event_id"]: x["id"] for x in g.nodes.filter(has_label(["Event"])).select("id", V.prop_str("event_id").alias("event_id")).collect()}
    rows = [(e["event_id"], e["operation"], by[ids[e["event_id"]]]) for e in events.list_events(g)]
    rows.append(("event:000009 again", outcome(lambda: events.append_event(g, "ann", "x", event_id="event:000009")), None))
    counts = {x["label"]: x["count"] for x in g.edges.groupBy("label").count().collect()}
    return frame(s, [*rows, *((k, str(counts[k]), None) for k in ("AUTHORED", "CAUSED_BY", "CITES")), ("actors", str(len(names)), None)], "what string, value string, actor string")


# tools that write
@query("memory_helpers", table_of([("file", 1), ("same file", 1), ("decision", 2), ("bug", 3), ("link", 1), ("same link", 1), ("task_kind is bug", 1)], "what, value"), NOTHING)
def _(s, d):
    with GraphStore(s) as m:
        rows = [("file", tools.record_file(m, "a.py", lang="py")), ("same file", tools.record_file(m, "a.py", size=3)), ("decision", tools.record_decision(m, "do it")), ("bug", tools.record_bug(m, "broken", task_kind="other"))]
        rows += [("link", tools.link(m, 2, "TOUCHES", 1)), ("same link", tools.link(m, 2, "TOUCHES", 1))]
        rows.append(("task_kind is bug", int(m.graph.get_node(3)["task_kind"] == "bug" and m.graph.get_node(1)["size"] == 3)))
    return frame(s, rows, "what string, value long")


@query("append_tool", table_of([("nodes", "1,2"), ("edges", "1"), ("no labels", "ValueError"), ("unknown end", "KeyError"), ("after failures", "2 1")], "what, value"), NOTHING)
def _(s, d):
    with GraphStore(s) as m:
        made = tools.append(m, [{"ref": "a", "labels": ["P"]}, {"ref": "b", "labels": ["P"], "properties": {"k": 1}}], [{"from": "a", "label": "R", "to": "b"}])
        rows = [("nodes", ",".join(map(str, made["nodes"]))), ("edges", ",".join(map(str, made["edges"])))]
        rows.append(("no labels", tools.append(m, [{"labels": ["Q"]}, {"labels": []}])["error"]["code"]))
        rows.append(("unknown end", tools.append(m, [{"labels": ["Q"]}], [{"from": "x", "label": "R", "to": 1}])["error"]["code"]))
        rows.append(("after failures", f"{m.graph.node_count()} {m.graph.edge_count()}"))
    return frame(s, rows, "what string, value string")


@query("merge_tool", table_of([("match", "updated 2"), ("no match", "created 3"), ("by id", "updated 1"), ("ambiguous", "ValueError"), ("nested match", "updated 3"), ("edge", "1"), ("same edge", "1")], "what, value"), NOTHING)
def _(s, d):
    with GraphStore(s) as m:
        tools.append(m, [{"labels": ["P"], "properties": {"k": 0, "t": "x"}}, {"labels": ["P", "Q"], "properties": {"k": 1, "t": "x"}}])
        one = lambda item: tools.merge_tool(m, [item])
        say = lambda r: f"{r['nodes'][0]['action']} {r['nodes'][0]['id']}" if "nodes" in r else r["error"]["code"]
        rows = [
            ("match", say(one({"match": {"labels": ["P", "Q"], "properties": {"k": 1.0}}, "properties": {"z": 2}}))),
            ("no match", say(one({"match": {"labels": ["P"], "properties": {"k": 9}}, "properties": {"list": [1, True]}}))),
            ("by id", say(one({"id": 1, "properties": {"z": 5}}))),
            ("ambiguous", say(one({"match": {"labels": ["P"], "properties": {"t": "x"}}}))),
            ("nested match", say(one({"match": {"properties": {"list": [1.0, 1]}}}))),
        ]
        edge = lambda: str(tools.merge_tool(m, [], [{"from": 1, "label": "R", "to": 2}])["edges"][0])
        rows += [("edge", edge()), ("same edge", edge())]
    return frame(s, rows, "what string, value string")


# command line
def run_cli(s, *args: str) -> tuple[int, str]:
    """Exit code and what was printed."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
        code = cli.main(list(args), s)
    return code, out.getvalue()


def stored_graphs(s, d) -> tuple[str, str, str]:
    """Folders of the small graph and of one that differs, and a folder beside them."""
    at = scratch(s, "graphs")
    other = mutate.update_node(mutate.delete_node(small(s, d), 20000000003), 20000000002, note="x")
    for name, g in (("left", small(s, d)), ("right", other)):
        with GraphStore(s, f"{at}/{name}") as store:
            store.graph = g
            store.commit()
    return f"{at}/left", f"{at}/right", at


@query(
    "cli_codes",
    table_of([("version", 0), ("help", 0), ("unknown", 2), ("diff same", 0), ("diff other", 1), ("diff both keys", 2), ("merge without output", 2), ("merge onto input", 2), ("merge dry", 0), ("merge blocked", 0), ("merge fail on conflict", 1), ("fail without dry", 2), ("merge", 0), ("merge again", 2), ("merge forced", 0), ("pack", 0), ("manifest", 0), ("stats", 0), ("export", 0), ("import", 0), ("import broken", 2), ("sign", 0), ("verify", 0), ("verify other", 1), ("trace", 0), ("trace none", 1), ("trace text", 0)], "command, code"),
    NOTHING,
)
def _(s, d):
    left, right, at = stored_graphs(s, d)
    files = Folder(s, at)
    files.write("key", "k")
    files.write("broken.json", "{}")
    out, signed = f"{at}/out", f"{at}/signed.json"
    region = str(small(s, d).edges.filter("src = 20000000003").first()["dst"])
    calls: dict[str, list[str]] = {
        "version": ["version"], "help": ["help"], "unknown": ["nonsense"], "diff same": ["diff", left, f"{at}/left2"], "diff other": ["diff", left, right], "diff both keys": ["diff", left, right, "--node-key", "name", "--identity-rules", f"{at}/broken.json"],
        "merge without output": ["merge", left, right], "merge onto input": ["merge", left, right, "-o", left], "merge dry": ["merge", left, right, "--node-key", "name", "--dry-run"],
        "merge blocked": ["merge", left, right, "--node-key", "size", "--dry-run"], "merge fail on conflict": ["merge", left, right, "--node-key", "size", "--dry-run", "--fail-on-conflict"], "fail without dry": ["merge", left, right, "--fail-on-conflict"],
        "merge": ["merge", left, right, "-o", out], "merge again": ["merge", left, right, "-o", out], "merge forced": ["merge", left, right, "-o", out, "--force"],
        "pack": ["pack", left, "--include-labels", "Region", "-o", f"{at}/packed"], "manifest": ["manifest", left], "stats": ["stats", left],
        "export": ["export", left, "-o", f"{at}/left.json"], "import": ["import", f"{at}/left.json", "-o", f"{at}/imported"], "import broken": ["import", f"{at}/broken.json", "-o", f"{at}/imported2"],
        "sign": ["sign", left, "--key-file", f"{at}/key"], "verify": ["verify", left, "--key-file", f"{at}/key", "--signature", signed], "verify other": ["verify", right, "--key-file", f"{at}/key", "--signature", signed],
        "trace": ["trace", left, "20000000003", region], "trace none": ["trace", left, region, "20000000003"], "trace text": ["trace", left, "20000000003", region, "--format", "text"],
    }
    with GraphStore(s, f"{at}/left2") as copy:
        copy.graph = small(s, d)
        copy.commit()
    rows = []
    for name, args in calls.items():
        code, printed = run_cli(s, *args)
        if name == "sign":
            files.write("signed.json", printed)
        rows.append((name, code))
    return frame(s, rows, "command string, code long")


@query("cli_merge", "SELECT id, name FROM nodes WHERE kind IN ('Region', 'Nation')")
def _(s, d):
    left, right, at = stored_graphs(s, d)
    run_cli(s, "merge", left, right, "--node-key", "name", "-o", f"{at}/out")
    with GraphStore(s, f"{at}/out") as store:
        return store.graph.nodes.select("id", V.prop_str("name").alias("name"))


@query("cli_diff_text", "SELECT pos, line FROM (" + SOME + ")")
def _(s, d):
    left, right, _ = stored_graphs(s, d)
    return frame(s, list(enumerate(run_cli(s, "diff", left, right, "--node-key", "name", "--format", "text")[1].splitlines())), "pos int, line string")


@query("cli_events", table_of([("append", "event:000001"), ("append from file", "event:000002"), ("list", "start,stop")], "command, result"), NOTHING)
def _(s, d):
    at = Folder(s, scratch(s, "events"))
    at.write("event.json", json.dumps({"actor": "ann", "operation": "stop", "timestamp": "2024-01-02T00:00:00Z"}))
    log = f"{at.path}/log"
    first = json.loads(run_cli(s, "events", "append", log, json.dumps({"actor": "ann", "operation": "start", "timestamp": "2024-01-01T00:00:00Z"}))[1])
    second = json.loads(run_cli(s, "events", "append", log, f"@{at.path}/event.json")[1])
    listed = json.loads(run_cli(s, "events", "list", log)[1])
    return frame(s, [("append", first["event_id"]), ("append from file", second["event_id"]), ("list", ",".join(e["operation"] for e in listed))], "command string, result string")
