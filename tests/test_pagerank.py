"""PageRank against plain rounds, and what it leaves on disk."""

from pathlib import Path

import pytest

from latticework.operators import traverse
from latticework.sources import tables as T


def plain(nodes, edges, iterations, alpha=0.85):
    """Round by round over lists."""
    links = set(edges)
    out = {v: sum(s == v for s, _ in links) for v in nodes}
    ranks = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(iterations):
        even = (1 - alpha + alpha * sum(r for v, r in ranks.items() if not out[v])) / len(nodes)
        ranks = {v: even + alpha * sum(ranks[s] / out[s] for s, d in links if d == v and s in ranks) for v in nodes}
    return ranks


TREE = ([1, 2, 3, 4, 5, 6], [(1, 2), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5)])
#: A cycle, a loop, a node that nothing reaches, ends outside the nodes.
CYCLES = ([1, 2, 3, 4, 5, 6, 7], [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (5, 1), (1, 99), (98, 2), (6, 7)])


def ranked(spark, graph, iterations):
    nodes, edges = graph
    found = traverse.pagerank(spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long"), iterations)
    rows = found.collect()
    assert len(rows) == len(nodes)
    return {r["id"]: r["rank"] for r in rows}


@pytest.mark.parametrize("graph", [TREE, CYCLES, ([1, 2], [])], ids=["tree", "cycles", "no edges"])
@pytest.mark.parametrize("iterations", [0, 2, 13])
def test_as_plain_rounds(spark, graph, iterations):
    assert ranked(spark, graph, iterations) == pytest.approx(plain(*graph, iterations), abs=1e-13)


def folders(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    return {p for p in shared.rglob("*") if p.is_dir() and (p.name.startswith("rdd-") or p.parent == shared)}


@pytest.mark.parametrize("graph, most", [(TREE, 4), (CYCLES, traverse.LAYERS + 1)], ids=["tree", "cycles"])
def test_tables_left_do_not_grow_with_the_rounds(spark, graph, most):
    ranked(spark, graph, 1)
    before = folders(spark)
    ranked(spark, graph, 50)
    assert len(folders(spark) - before) <= most


def test_links_need_no_line_numbers(spark):
    links = T.commerce_links(spark, "/root/testdata/sf0.001")
    assert "Window" not in links._jdf.queryExecution().optimizedPlan().toString()
    edges = T.commerce_edges(spark, "/root/testdata/sf0.001").select("src", "dst")
    assert links.exceptAll(edges).isEmpty() and edges.exceptAll(links).isEmpty()
