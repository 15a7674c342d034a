import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from latticework.llm import bpe, ordinal_quality

SF_DIR = "/root/testdata/sf0.001"


def made(seed, n=500):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "an", "or", "in", "er") for b in ("st", "nd", "ti", "ha", "re", "")]
    docs, labels = [], []
    for i in range(n):
        kind = r.choices((0, 1, 2), weights=(2, 2, 5))[0]
        t = [r.choice(words) for _ in range(r.randint(5, 120))]
        if kind == 0:
            t = [w.upper() + "!!" for w in t] if r.random() < 0.5 else [w + "***" for w in t]
        elif kind == 1:
            for _ in range(max(2, len(t) // 6)):
                t[r.randrange(len(t))] = r.choice(("idiot", "worthless", "clown"))
        docs.append((i, " ".join(t), "en", "s", 1, "mine"))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string"


def test_held_out_grades(spark):
    docs, labels = made(1)
    odd = [(9000, None, "en", "s", 0, "mine"), (9001, "", "en", "s", 0, "mine"), (9002, "word " * 30000, "en", "s", 0, "mine"), (0, docs[0][1], "en", "s", 1, "mine"), (None, docs[1][1], "en", "s", 1, "mine")]
    df = spark.createDataFrame(docs + odd, DOCS)
    lab = spark.createDataFrame([(d, q, t) for d, q, t in labels[:300]] + [(7, None, None), (None, 1, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    model = ordinal_quality.train(df, lab)
    assert model.thresholds[0] < model.thresholds[1]
    rows = ordinal_quality.score(df, model).collect()
    assert len(rows) == len(docs) + len(odd)
    by_id = {r["doc_id"]: r for r in rows}
    right = [by_id[d]["keep"] == bool(q) for d, q, _ in labels[300:]]
    assert np.mean(right) > 0.97
    mean = {k: np.mean([by_id[d]["expected_grade"] for d, q, t in labels[300:] if (q + q * (1 - t)) == k]) for k in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    for r in rows:
        assert 0 <= r["p_grade_2"] <= r["p_grade_1"] <= 1
        assert r["expected_grade"] == pytest.approx(r["p_grade_1"] + r["p_grade_2"])


def test_one_grade_or_none(spark):
    df = spark.createDataFrame(made(2, 20)[0], DOCS)
    none = ordinal_quality.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r["keep"] for r in ordinal_quality.score(df, none).collect())
    one = ordinal_quality.train(df, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    assert all(r["keep"] for r in ordinal_quality.score(df, one).collect())
    assert ordinal_quality.score(df.limit(0), one).count() == 0


def test_gradient_steps_lower_the_loss():
    r = np.random.default_rng(0)
    idx = [np.array([i % 3, 5]) for i in range(60)]
    grades = np.array([i % 3 for i in range(60)])
    model = ordinal_quality.fit(grades, idx, [np.ones(2) for _ in idx])
    s = np.array([model.weights[i].sum() for i in idx])
    tails = model.tails(s)
    guess = (tails > 0.5).sum(1)
    assert (guess == grades).mean() > 0.95 and r is not None


def test_the_sample_is_bounded_by_ids_not_rows(spark):
    docs = [(i % 3, f"text number {i} goes here", "en", "s", 1, "x") for i in range(60)]
    lab = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    one = ordinal_quality.train(spark.createDataFrame(docs, DOCS), lab, sample=2)
    again = ordinal_quality.train(spark.createDataFrame(docs[::-1], DOCS).repartition(5), lab, sample=2)
    assert (one.weights == again.weights).all() and one.thresholds == again.thresholds


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], DOCS)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == "tokens" or out.columns == docs.columns


def test_long_words_have_whole_shapes():
    assert ordinal_quality.shape("a1" * 30) == "a9" * 30


def test_shapes():
    assert ordinal_quality.shape("Hello,") == "Aa," and ordinal_quality.shape("WORD!!!") == "A!!" and ordinal_quality.shape("ab***") == "a**" and ordinal_quality.shape("x12y") == "a9a"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")
def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as cp
    from latticework.llm.runtime import stored

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF_DIR))
        kept[name] = docs.collect()
    source = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}

    model = ordinal_quality.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = set()
    for d, r in source.items():
        i, v = ordinal_quality.sparse(r["text"])
        if 1 / (1 + np.exp(model.thresholds[0] - float(np.dot(model.weights[i], v)))) >= ordinal_quality.KEEP_AT:
            want.add(d)
    first = {r["doc_id"] for r in kept["quality"]}
    assert first == want
    clean = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(d in first for d in clean) / len(clean) > 0.98

    def shingles(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    ids = sorted(first)
    bag, root = {d: shingles(source[d]["text"]) for d in ids}, {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 5 * sum((bag[a] & bag[b]).values()) >= 4 * sum((bag[a] | bag[b]).values()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    second = {r["doc_id"] for r in kept["near_duplicates"]}
    assert second == {find(d) for d in ids} and len(kept["near_duplicates"]) == len(second)

    third = Counter(r["doc_id"] for r in kept["mixture"])
    assert set(third) <= second and max(third.values()) <= 2
    assert all(r["text"] == source[r["doc_id"]]["text"] for r in kept["mixture"])

    t = Tokenizer.from_file(bpe.vocabulary_path())
    last = Counter((r["doc_id"], r["n_tokens"]) for r in kept["tokens"])
    assert last == Counter((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids)) for r in kept["mixture"])
    assert sorted(map(tuple, cp.run(spark, SF_DIR).collect())) == sorted(map(tuple, kept["tokens"]))


def test_scores_equal_a_plain_sum(spark):
    docs, labels = made(5, 150)
    docs += [(9000, None, "en", "s", 0, "x"), (9001, " \n", "en", "s", 0, "x"), (9002, "same same same Other", "en", "s", 0, "x")]
    df = spark.createDataFrame(docs, DOCS)
    model = ordinal_quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in ordinal_quality.score(df, model).collect()}
    for d, t, *_ in docs:
        words, total = (t or "").split(), 0.0
        for i, w in enumerate(words):
            total += float(model.weights[zlib.crc32(b"w" + w.lower().encode()) % 65536]) + float(model.weights[zlib.crc32(b"s" + ordinal_quality.shape(w).encode()) % 65536])
            if i and words[i - 1] == w:
                total += float(model.weights[zlib.crc32(b"repeat") % 65536])
        s = total / max(len(words), 1)
        tails = [1 / (1 + np.exp(t - s)) for t in model.thresholds]
        assert got[d]["score"] == pytest.approx(s, abs=1e-9)
        assert [got[d]["p_grade_1"], got[d]["p_grade_2"]] == pytest.approx(tails) and got[d]["keep"] == (tails[0] >= ordinal_quality.KEEP_AT)
