import random
from collections import Counter

import numpy as np

from latticework.llm import bags, near_dedup
from latticework.llm.graph_components import components


def shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_classes(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    own = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            inter, union = sum((own[i] & own[j]).values()), sum((own[i] | own[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or (union and 5 * inter >= 4 * union):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d is None, d or 0), least.get(root(i), -1)) for i, (d, _) in enumerate(rows))


def family(r, words, copies, most):
    base = [r.choice(words) for _ in range(r.randint(20, 120))]
    out = [" ".join(base)]
    for _ in range(copies):
        t = list(base)
        for _ in range(r.randint(0, most)):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.2:
            t = t + t[:10]
        out.append(" ".join(t))
    return out


def test_classes_equal_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(12) for t in family(r, words, r.choice([0, 1, 3, 12]), r.choice([1, 3, 8]))]
    texts += ["", "", None, " ", "one", "one", "two words", "two  words", "x " * 300, "x " * 310, "long " + " ".join(r.choice(words) for _ in range(8000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, "alone without id")]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "k", "b") for d, t in rows], "doc_id long, text string, key string, band string")
    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0), -1 if x["class_id"] is None else x["class_id"]) for x in near_dedup.classes(df).collect())
    assert got == plain_classes(rows)


def test_large_family_near_the_limit(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(r.randint(0, 9)):
            k = r.randrange(len(t))
            t[k] = t[k].upper() if r.random() < 0.4 else r.choice(words)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((False, x["doc_id"]), x["class_id"]) for x in near_dedup.classes(df).collect())
    want = plain_classes(rows)
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 2  # banding may miss a link at the limit


def test_signatures_estimate_weighted_overlap():
    r = random.Random(3)
    near = []
    for k in range(40):
        a = [f"w{r.randrange(900)}" for _ in range(r.randint(1, 300))]
        b = list(a)
        for _ in range(r.randint(0, 12)):
            b[r.randrange(len(b))] = "zz"
        if k % 2:
            a, b = a * 3, b * 3
        text, element, weight = bags.bag([a, b], bags.WordHashes())
        s = bags.bag_min_hash(text, element, weight, 2, 800)
        inter, union = bags.overlap((element[text == 0], weight[text == 0]), (element[text == 1], weight[text == 1]))
        assert (inter, union) == (sum((shingles(" ".join(a)) & shingles(" ".join(b))).values()), sum((shingles(" ".join(a)) | shingles(" ".join(b))).values()))
        near.append((s[0] == s[1]).mean() - inter / union)
    assert np.abs(near).max() < 0.08 and abs(np.mean(near)) < 0.02


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_keeps_one_of_each_class(spark):
    rows = [(4, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (2, "a b c d e f g h", "y"), (9, "other words stand here now", "z"), (None, "no id at all in here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    out = near_dedup.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in out.collect()) == [(0, "q"), (2, "y"), (9, "z")]


def test_stage_keeps_classes_without_ids_and_texts_that_share_one(spark):
    one, two, three, four = "a b c d e f g h", "other words stand here now", "no id at all in here", "nor does this one have any"
    rows = [(7, one, "p"), (7, two, "q"), (None, one, "r"), (None, three, "s"), (None, four, "u"), (None, four, "t"), (3, two, "v"), (7, two, "w")]
    want = [(-1, three, "s"), (-1, four, "t"), (3, two, "v"), (7, one, "p")]
    for some in (rows, rows[::-1]):
        out = near_dedup.stage(spark, spark.createDataFrame(some, "doc_id long, text string, lang string"), "")
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["lang"]) for r in out.collect()) == sorted(want)


def test_classes_without_ids_have_names_of_their_own(spark):
    texts = ["no id at all in here", "nor does this one have any", "nor does this one have any", "a third text stands alone"]
    df = spark.createDataFrame([(None, t) for t in texts] + [(-4, "text with an id below zero")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"]) for r in near_dedup.classes(df).collect())
    assert [c for d, c in got if d] == [-4]
    assert sorted(Counter(c for d, c in got if not d).values()) == [1, 1, 2] and max(c for d, c in got if not d) == -5


def test_a_family_with_too_small_a_template_is_not_paired(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(170)]
    rows = [(i, " ".join(base + [f"u{i}x{k}" for k in range(30)])) for i in range(400)]
    paired = []
    plain = near_dedup.prefix_pairs
    monkeypatch.setattr(near_dedup, "prefix_pairs", lambda *a: paired.append(plain(*a)) or paired[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dedup.classes(df).select("class_id").distinct().count() == 400
    assert paired[0].count() == 0


def test_every_pair_near_enough_is_found(spark):
    """Recall by true overlap: of pairs at 0.8 or more, banding may miss few."""
    r = random.Random(7)
    rows, pairs = [], []
    for i in range(300):
        a = [f"w{r.randrange(4000)}" for _ in range(r.randint(60, 200))]
        b = list(a)
        for k in r.sample(range(len(b)), max(1, len(b) // r.randint(40, 80))):
            b[k] = "other"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs.append(sum((x & y).values()) / sum((x | y).values()))
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i for i, o in enumerate(pairs) if o >= 0.8]
    assert len(near) > 50 and all(got[2 * i] == got[2 * i + 1] for i in near)
    assert all(got[2 * i] != got[2 * i + 1] for i, o in enumerate(pairs) if o < 0.8)


def test_empty(spark):
    assert near_dedup.stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string"), "").count() == 0
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
