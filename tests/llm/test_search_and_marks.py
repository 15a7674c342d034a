import hashlib
import random

import numpy as np

from latticework.llm import fingerprints, nearest, phrases


def test_search_equals_brute_force_on_few_and_recalls_on_many(spark):
    r = np.random.default_rng(0)
    for n, least in ((90, 1.0), (3000, 0.9)):
        x = r.normal(size=(n, 16)).round(2)
        x[5], x[7] = x[300 % n], x[300 % n]
        rows = [(i, [float(v) for v in x[i]], "l") for i in range(n)]
        odd = [(n + 100, None, "l"), (n + 200, [0.0] * 16, "l"), (n + 300, [float("nan")] * 16, "l"), (n + 400, [None] + [1.0] * 15, "l"), (n + 500, [1.0] * 3, "l"), (None, [1.0] * 16, "l"), (n + 600, [float("inf")] * 16, "l"), (n + 700, [], "l")]
        df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
        x = x.astype(np.float32).astype(float)
        got = {}
        for g in nearest.search(df).collect():
            got.setdefault(g["query_id"], {})[g["rank"]] = (g["vec_id"], g["score"])
        assert set(got) == set(range(0, n, 100))
        hits = []
        for q, found in got.items():
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            want = sorted((d[i], i) for i in range(n) if i != q)[:10]
            assert sorted(found) == list(range(1, 11))
            assert all(d[i] == s for i, s in found.values())
            assert [found[k][1] for k in sorted(found)] == sorted(s for _, s in found.values())
            hits.append(len({i for i, _ in found.values()} & {i for _, i in want}) / 10)
            if least == 1.0:
                assert [found[k][0] for k in sorted(found)] == [i for _, i in want]
        assert np.mean(hits) >= least


def test_search_of_nothing_little_and_copies(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.search(spark.createDataFrame([], schema)).count() == 0
    few = nearest.search(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0]), (2, [9.0])], schema)).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 1.0)]
    many = nearest.search(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(2500)], schema)).collect()
    assert {tuple(sorted(r["vec_id"] for r in many if r["query_id"] == 100))} == {tuple(range(10))}


def test_graph_search_reaches_all_that_it_should():
    x = np.random.default_rng(1).normal(size=(4000, 8))
    c = nearest.build(x, 60)
    d = np.sqrt(((c.points - x[0]) ** 2).sum(1))
    found = c.search(x[0], 1.3)
    assert found == sorted(found, key=lambda i: d[i]) and set(np.flatnonzero(d <= d.min() * 1.3)) == set(found)
    assert len(c.search(x[0], 1.0, np.ones(len(d), int), 10**9)) == len(d)


def text(r, n):
    return "".join(r.choice("abcdefgh ijklm") for _ in range(n))


def test_equal_substrings_share_phrases_at_any_offset():
    r = random.Random(1)
    for n in (400, 3000):
        t = text(r, n)
        a, b, c = phrases.sketches([t, text(r, 37) + t, text(r, n)])
        assert phrases.likeness(a, b) > 0.6 and phrases.likeness(a, c) < 0.1
    again = phrases.sketches(["x", t, "", "aaaa"])
    listed = lambda s: [x.tolist() for x in s]
    assert listed(again[1]) == listed(a) and listed(again[2]) == [[], []] and len(again[0][0]) == len(again[3][0]) == 1
    assert listed(phrases.read(phrases.written(a))) == listed(a) and phrases.written(again[2]) == ""


def plain_neighbours(rows):
    order = sorted(rows, key=lambda x: -x[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out[d] = (len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())
    return out


def test_fingerprints_of_neighbours(spark):
    r = random.Random(2)
    rows = [(i * 7 - 50, text(r, r.choice([0, 1, 2, 3, 20, 300, 2000]))) for i in range(60)] + [(1000, None), (1001, "é" * 9), (1002, "same text here"), (1003, "same text here"), (1004, text(r, 90000))]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(7)
    got = {x["doc_id"]: x for x in fingerprints.fingerprinted(df, keep_edited=True).collect()}
    want = plain_neighbours(rows)
    assert {d: (x["n_chars"], x["edited_sha256"]) for d, x in got.items()} == want
    assert got[1002]["fingerprint"] == got[1003]["fingerprint"] and got[1003]["near_next"] == 1.0
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in got.values())
    long = [x for x in got.values() if x["n_chars"] >= 300]
    assert all(x["near_edited"] > 0.2 > x["near_next"] for x in long)
    assert all(x["near_edited"] == 1.0 for x in got.values() if x["n_chars"] < 3)


def test_fingerprints_of_few_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprinted(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.fingerprinted(spark.createDataFrame([(5, "abcdef")], schema)).collect()
    assert [(r["doc_id"], r["edited_sha256"]) for r in one] == [(5, hashlib.sha256(b"abcdab").hexdigest())]
    odd = fingerprints.fingerprinted(spark.createDataFrame([(None, "a"), (None, "b"), (3, "abc"), (3, "abc")], schema)).collect()
    assert len(odd) == 4


def test_short_and_longer_texts_are_compared_by_the_same_levels():
    r = random.Random(9)
    for whole, part in ((66, 44), (110, 73), (64, 60), (90, 62)):
        found = []
        for _ in range(20):
            t = text(r, whole)
            a, b, c = phrases.sketches([t, t[:part], text(r, whole)])
            found.append(phrases.likeness(a, b))
            assert phrases.likeness(a, c) < phrases.likeness(a, b)
        assert np.mean(found) > 0.6 * part / whole, (whole, part, np.mean(found))


def test_rows_without_ids_and_frequent_ids_are_dealt_over_buckets(spark):
    r = random.Random(10)
    rows = [(None, text(r, 40)) for _ in range(400)] + [(7, text(r, 40)) for _ in range(300)] + [(i, text(r, 40)) for i in range(20, 220)] + [(None, "same")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seats = fingerprints.neighboured(df)
    sizes = [x["count"] for x in seats.groupBy("bucket").count().collect()]
    assert max(sizes) < 250 and sum(sizes) - len(rows) < 200
    got = fingerprints.fingerprinted(df, keep_edited=True).collect()
    assert len(got) == len(rows)
    order = sorted({t for d, t in rows if d is None})
    by_hash = {x["text"]: x["tie"] for x in spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) as tie").distinct().collect()}
    line = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), by_hash[x[1]]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + line[(i + 1) % len(line)][1][: len(t) // 3]).encode()).hexdigest() for i, (_, t) in enumerate(line))
    assert sorted(x["edited_sha256"] for x in got) == want and order


def test_many_vectors_are_sampled_and_queries_searched_in_heaps(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SAMPLE", 300)
    monkeypatch.setattr(nearest, "LIST_SIZE", 32)
    monkeypatch.setattr(nearest, "SALT_ROWS", 100)
    monkeypatch.setattr(nearest, "HEAP_ROWS", 3)
    x = np.random.default_rng(2).normal(size=(2500, 6))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(2500)], "vec_id long, embedding array<double>")
    got = {}
    for g in nearest.search(df).collect():
        got.setdefault(g["query_id"], {})[g["rank"]] = g["vec_id"]
    hits = []
    for q in range(0, 2500, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(set(np.argsort(d)[:10].tolist()) & set(got[q].values())) / 10)
    assert len(got) == 25 and np.mean(hits) >= 0.9


def plain_level(x):
    """Phrase names of one level, symbol by symbol."""
    mask = (1 << 64) - 1

    def mixed(v):
        v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & mask
        v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & mask
        return v ^ (v >> 31)

    runs = []
    for v in x:
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    if len(runs) < len(x):
        x = [mixed(v ^ (n * 0xD6E8FEB86659FD93 & mask)) if n > 1 else v for v, n in runs]
    label, bits = list(x), 64
    for _ in range(3):
        before = None
        new = []
        for v in label:
            left = ~v & ((1 << bits) - 1) if before is None else before
            differs = v ^ left
            low = bits if not differs else (differs & -differs).bit_length() - 1
            new.append(2 * low + ((v >> low) & 1 if low < bits else 0))
            before = v
        label, bits = new, 8
    n, starts = len(x), []
    for i in range(n):
        if i == 0:
            starts.append(i)
        elif i == 1:
            continue
        elif label[i] > label[i - 1] and (i == n - 1 or label[i] >= label[i + 1]):
            starts.append(i)
    cuts = [*starts, n]
    return [mixed(sum(mixed((x[a + k] + k * 0x9E3779B97F4A7C15) & mask) for k in range(b - a)) & mask) for a, b in zip(cuts, cuts[1:], strict=False)], mixed


def plain_sketch(t):
    if not t:
        return [], []
    x, first, higher, depth = [ord(c) + 1 for c in t], [], set(), 0
    while True:
        x, mixed = plain_level(x)
        depth += 1
        names = {mixed((v + depth) & ((1 << 64) - 1)) >> 32 for v in x}
        if depth == 1:
            first = sorted(names)[: phrases.FIRST]
        else:
            higher |= names
        if len(x) == 1:
            return first, sorted(higher)[: phrases.HIGHER]


def test_sketches_equal_a_plain_parse():
    r = random.Random(21)
    texts = ["", "a", "aa", "ab", "aab", "aaaaaaab", "abababab"] + [text(r, n) for n in (3, 5, 9, 40, 41, 300)] + ["é\u2003" * 20 + "𝒳" * 5 + "end"]
    for t, got in zip(texts, phrases.sketches(texts), strict=True):
        first, higher = plain_sketch(t)
        assert got[0].tolist() == first and got[1].tolist() == higher, t[:40]
    for a in texts[:8]:
        for b in texts[5:]:
            x, y = plain_sketch(a), plain_sketch(b)
            hits = seen = 0
            for u, v, k in zip(x, y, (phrases.FIRST, phrases.HIGHER), strict=True):
                least = sorted(set(u) | set(v))[:k]
                hits, seen = hits + len([z for z in least if z in u and z in v]), seen + len(least)
            assert phrases.likeness(*phrases.sketches([a, b])) == (hits / seen if seen else 1.0)
