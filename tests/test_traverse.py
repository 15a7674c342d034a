import random
from collections import deque

import pytest

from latticework.errors import NodeNotFoundError
from latticework.operators import traverse
from latticework.operators.graph import PropertyGraph


def graph(spark, n, pairs):
    return PropertyGraph.of(spark, [([], {})] * n, [(a, "L", b, {}) for a, b in pairs])


def newest_first(pairs):
    out = {}
    for a, b in reversed(pairs):
        out.setdefault(a, []).append(b)
    return out


def queue_walk(pairs, start, depth):
    out, seen, todo, found, parent = newest_first(pairs), {start}, deque([(start, 0)]), [], {}
    while todo:
        x, d = todo.popleft()
        if d == depth:
            continue
        for y in out.get(x, []):
            if y not in seen:
                seen.add(y)
                parent[y] = x
                found.append((y, d + 1))
                todo.append((y, d + 1))
    return found, parent


def stack_walk(pairs, start, depth):
    out, seen, stack, found = newest_first(pairs), {start}, [(start, 0)], []
    while stack:
        x, d = stack.pop()
        if x != start:
            found.append((x, d))
        if d < depth:
            for y in out.get(x, []):
                if y not in seen:
                    seen.add(y)
                    stack.append((y, d + 1))
    return found


def test_order_fixtures(spark):
    star = graph(spark, 4, [(1, 2), (1, 3), (1, 4)])
    assert [r["id"] for r in traverse.bfs(star, 1, 3).collect()] == [4, 3, 2]
    assert [r["id"] for r in traverse.dfs(star, 1, 3).collect()] == [2, 3, 4]
    two = graph(spark, 4, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert [r["id"] for r in traverse.shortest_path(two, 1, 4).collect()] == [1, 3, 4]
    loop = graph(spark, 2, [(1, 1), (1, 2)])
    assert [(r["id"], r["depth"]) for r in traverse.bfs(loop, 1, 5).collect()] == [(2, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_against_sequential_walks(spark, seed):
    r = random.Random(seed)
    n = r.randint(4, 9)
    pairs = [(r.randint(1, n), r.randint(1, n)) for _ in range(r.randint(3, 18))]
    g = graph(spark, n, pairs)
    depth = r.randint(1, 4)
    found, _ = queue_walk(pairs, 1, depth)
    assert [(x["id"], x["depth"]) for x in traverse.bfs(g, 1, depth).collect()] == found
    assert [(x["id"], x["depth"]) for x in traverse.dfs(g, 1, depth).collect()] == stack_walk(pairs, 1, depth)
    _, parent = queue_walk(pairs, 1, n)
    goal = r.randint(2, n)
    path = traverse.shortest_path(g, 1, goal)
    if goal not in parent:
        assert path is None
    else:
        want = [goal]
        while want[-1] != 1:
            want.append(parent[want[-1]])
        assert [x["id"] for x in path.collect()] == want[::-1]


def test_missing_nodes(spark):
    g = graph(spark, 2, [(1, 2)])
    assert traverse.bfs(g, 9, 0).collect() == []
    with pytest.raises(NodeNotFoundError):
        traverse.bfs(g, 9, 1)
    with pytest.raises(NodeNotFoundError):
        traverse.shortest_path(g, 9, 1)
    assert traverse.shortest_path(g, 9, 9) is None
    assert traverse.shortest_path(g, 1, 9) is None
    assert [r["id"] for r in traverse.shortest_path(g, 1, 1).collect()] == [1]


def test_pagerank_sums_to_one_and_collapses_parallel_edges(spark):
    g = graph(spark, 4, [(1, 2), (1, 2), (2, 3), (3, 1), (3, 4)])
    ranks = {r["id"]: r["rank"] for r in traverse.pagerank(g.nodes, g.edges, 20).collect()}
    links, rank = {1: {2}, 2: {3}, 3: {1, 4}, 4: set()}, dict.fromkeys(range(1, 5), 0.25)
    for _ in range(20):
        d = sum(rank[x] for x in links if not links[x])
        rank = {x: 0.15 / 4 + 0.85 * (sum(rank[y] / len(links[y]) for y in links if x in links[y]) + d / 4) for x in links}
    assert abs(sum(ranks.values()) - 1) < 1e-9
    assert all(abs(ranks[x] - rank[x]) < 1e-9 for x in rank)


def test_navigation_paths(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, id long")
    rows = spark.createDataFrame([("a;b;<;c",), ("a;zz;b;c",)], "path string")
    got = sorted((r["src"], r["dst"]) for r in traverse.paths_from_navigation(rows, nodes).collect())
    assert got == [(1, 2), (2, 3), (2, 3)]


def test_large_frontiers_are_numbered_by_range(spark, monkeypatch):
    monkeypatch.setattr(traverse, "WINDOW_ROWS", 0)
    r = random.Random(11)
    pairs = [(r.randint(1, 40), r.randint(1, 40)) for _ in range(160)]
    g = graph(spark, 40, pairs)
    found, _ = queue_walk(pairs, 1, 4)
    assert [(x["id"], x["depth"]) for x in traverse.bfs(g, 1, 4).collect()] == found
    starts = spark.createDataFrame([(1,), (2,), (3,)], "start long")
    got = traverse.ranked(traverse.bfs_from(g.edges, starts, 4)).filter("depth > 0").orderBy("start", "rank").collect()
    for s in (1, 2, 3):
        assert [(x["id"], x["depth"], x["rank"]) for x in got if x["start"] == s] == [(i, d, k) for k, (i, d) in enumerate(queue_walk(pairs, s, 4)[0], 1)]


def test_no_task_sorts_a_whole_result(spark):
    from pyspark.sql import functions as F

    g = graph(spark, 4, [(1, 2), (1, 3), (2, 4)])
    plan = traverse.ranked(traverse.bfs_from(g.edges, spark.createDataFrame([(1,)], "start long"), 3))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and F is not None


def test_simple_cycles_against_a_walk(spark):
    r = random.Random(12)
    pairs = [(r.randint(1, 7), r.randint(1, 7)) for _ in range(22)]
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = set()

    def walk(path):
        for y in out.get(path[-1], ()):
            if y == path[0]:
                want.add(tuple(path))
            elif y > path[0] and y not in path and len(path) < 4:
                walk([*path, y])

    for x in range(1, 8):
        walk([x])
    got = [tuple(x["cycle"]) for x in traverse.simple_cycles(graph(spark, 7, pairs).edges, 4).collect()]
    assert sorted(got) == sorted(want)
