import random

import pytest

from latticework.errors import MergeError, UsageError
from latticework.functions import values as V
from latticework.operators import diff, merge
from latticework.operators.graph import PropertyGraph


def content(graph):
    nodes = {r["id"]: (tuple(r["labels"]), V.decode_props(r["props"])) for r in graph.nodes.collect()}
    edges = {r["id"]: (r["src"], r["label"], r["dst"], V.decode_props(r["props"])) for r in graph.edges.collect()}
    return nodes, edges


def merged_by_hand(dst, src, keys, strategy, mode):
    nodes, edges = {i: (n[0], dict(n[1])) for i, n in enumerate(dst[0], 1)}, dict(enumerate(dst[1], 1))
    moved, top_n, top_e = {}, len(nodes), len(edges)
    for i, (labels, props) in enumerate(src[0], 1):
        hit = next((j for j in sorted(nodes) if keys and all(k in nodes[j][1] and nodes[j][1][k] == props[k] for k in keys)), None)
        if hit is None:
            top_n += 1
            nodes[top_n], moved[i] = (labels, dict(props)), top_n
        else:
            moved[i] = hit
            if mode == "overwrite_from_src":
                nodes[hit][1].update(props)
            elif mode == "merge_props":
                for k, v in props.items():
                    nodes[hit][1].setdefault(k, v)
    for s, label, d, props in src[1]:
        e = (moved[s], label, moved[d], props)
        if strategy == "append" or e not in edges.values():
            top_e += 1
            edges[top_e] = e
    return {i: (tuple(n[0]), n[1]) for i, n in nodes.items()}, edges


@pytest.mark.parametrize("seed", range(5))
def test_merge_against_a_sequential_model(spark, seed):
    r = random.Random(seed)

    def made():
        n = r.randint(1, 5)
        nodes = [([r.choice("AB")], {"k": r.randint(1, 3)} | ({"x": r.randint(1, 2)} if r.random() < 0.6 else {})) for _ in range(n)]
        return nodes, [(r.randint(1, n), r.choice("RS"), r.randint(1, n), {"w": r.randint(1, 2)}) for _ in range(r.randint(0, 5))]

    dst, src = made(), made()
    keys, strategy, mode = r.choice([["k"], None]), r.choice(merge.EDGES), r.choice(merge.CONFLICTS)
    got = merge.merge_from(PropertyGraph.of(spark, *dst), PropertyGraph.of(spark, *src), keys, strategy, mode)
    assert content(got.graph) == merged_by_hand(dst, src, keys, strategy, mode), (keys, strategy, mode)


def test_merge_report_and_rerun(spark):
    left = PropertyGraph.of(spark, [(["P"], {"tag": "A"})])
    right = PropertyGraph.of(spark, [(["P"], {"tag": "A"}), (["P"], {"tag": "B"})], [(1, "R", 2, {})])
    first = merge.merge_from(left, right, ["tag"], "idempotent")
    assert first.report() == {"nodes_created": 1, "nodes_reused": 1, "edges_created": 1, "edges_reused": 0}
    again = merge.merge_from(first.graph, right, ["tag"], "idempotent")
    assert again.report() == {"nodes_created": 0, "nodes_reused": 2, "edges_created": 0, "edges_reused": 1}


def test_merge_refusals(spark):
    g = PropertyGraph.of(spark, [(["P"], {"tag": 1})])
    h = PropertyGraph.of(spark, [(["P"], {})])
    with pytest.raises(ValueError):
        merge.merge_from(g, g)
    with pytest.raises(MergeError):
        merge.merge_from(g, h, [])
    with pytest.raises(MergeError):
        merge.merge_from(g, h, ["tag"])
    with pytest.raises(ValueError):
        merge.merge_from(g, h, None, "sometimes")
    with pytest.raises(ValueError):
        merge.merge_from(g, h, None, "append", "shout")


def test_preview_conflicts_and_warnings(spark):
    left = PropertyGraph.of(spark, [(["P"], {"k": 1}), (["P"], {"k": 1}), (["P"], {"k": 2, "s": "open"})])
    right = PropertyGraph.of(spark, [(["P"], {"k": 1}), (["P"], {})])
    report = merge.preview(left, right, ["k"])
    assert not report["can_merge"] and report["report"]["nodes_created"] == 0
    assert {c["type"] for c in report["conflicts"]} == {"missing_node_key", "duplicate_node_key", "ambiguous_destination_node_key"}
    other = PropertyGraph.of(spark, [(["Q", "P"], {"k": 2, "s": "done"})])
    one = PropertyGraph.of(spark, [(["P"], {"k": 2, "s": "open"})])
    told = merge.preview(one, other, ["k"])["warnings"]
    assert [(w["type"], w["key"], w["dst_value"], w["src_value"]) for w in told] == [("node_label_difference", None, "P", "P,Q"), ("node_property_conflict", "s", "open", "done")]
    ruled = merge.preview(one, PropertyGraph.of(spark, [(["Note"], {})]), rules={"P": ["k"]})
    assert [c["type"] for c in ruled["conflicts"]] == ["unmatched_identity_rule"]


def test_diff_modes(spark):
    a = PropertyGraph.of(spark, [(["File"], {"path": "a", "t": "A"}), (["File"], {"path": "b"})], [(1, "DEP", 2, {"why": "old"})])
    b = PropertyGraph.of(spark, [(["File"], {"path": "b"}), (["File"], {"path": "a", "t": "A"})], [(2, "DEP", 1, {"why": "old"})])
    assert not diff.diff(a, b, ["path"])["changed"]
    assert diff.diff(a, b)["changed"]
    c = PropertyGraph.of(spark, [(["File"], {"path": "a", "t": "A2"}), (["File"], {"path": "b"})], [(1, "DEP", 2, {"why": "new"})])
    report = diff.diff(a, c, ["path"])
    assert report["nodes"] == {"added": [], "removed": [], "changed": ["path='a'"]}
    assert report["edges"]["changed"] == [] and len(report["edges"]["added"]) == len(report["edges"]["removed"]) == 1
    assert diff.diff(a, c, rules={"File": ["path"]})["nodes"]["changed"] == ["File:path='a'"]
    with pytest.raises(UsageError):
        diff.diff(a, c, ["t"])
    with pytest.raises(UsageError):
        diff.diff(a, c, ["path"], {"File": ["path"]})
    assert diff.format_text(report).startswith("Nodes: +0 -0 ~1\n  ~ path='a'")


def test_edge_multiset_diff(spark):
    two = PropertyGraph.of(spark, [(["N"], {"k": 1}), (["N"], {"k": 2})], [(1, "L", 2, {}), (1, "L", 2, {})])
    one = PropertyGraph.of(spark, [(["N"], {"k": 1}), (["N"], {"k": 2})], [(1, "L", 2, {})])
    assert diff.diff(two, one, ["k"])["edges"]["removed"] == ["k=1 -[L]-> k=2"]


def test_loose_values_do_not_count_as_changes(spark):
    a, b = (PropertyGraph.of(spark, [(["N"], {"k": "x", "v": v})]) for v in (1, 1.0))
    assert not diff.diff(a, b)["changed"]


def test_identities_that_need_python_are_found_in_the_one_pass(spark):
    from latticework.operators.diff import identities
    from latticework.operators.graph import PropertyGraph

    rows = [(["A"], {"k": 1.0}), (["A"], {"k": "it's"}), (["A"], {"k": [1, "x"]}), (["B"], {"k": 1}), (["B"], {"k": "plain"})]
    g = PropertyGraph.of(spark, rows)
    want = {i: f"k={p['k']!r}" for i, (_, p) in enumerate(rows, 1)}
    assert {r["id"]: r["identity"] for r in identities(g.nodes, ["k"], None).collect()} == want
    got = identities(g.nodes, None, {"A": ["k"], "B": ["k"]}).collect()
    assert {r["id"]: r["identity"] for r in got} == {i: f"{rows[i - 1][0][0]}:{t}" for i, t in want.items()}
