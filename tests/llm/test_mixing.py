import heapq
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from latticework.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        per = left / sum(w[s] for s in open_)
        over = {s for s in open_ if per * w[s] >= epochs * sizes[s]}
        if not over:
            return target | {s: per * w[s] for s in open_}
        for s in over:
            target[s] = float(epochs * sizes[s])
        open_ -= over
    return target


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string")


def made(seed, n=300):
    r = random.Random(seed)
    sources = ["a", "b", "é", "Z", None, "zz", "empty"]
    rows = []
    for i in range(n):
        s = r.choices(sources, weights=[30, 5, 3, 3, 2, 1, 1])[0]
        rows.append((i, None if s == "empty" else " ".join(["wörd"] * r.choice([0, 1, 5, 40, 90, 400])), s, "x", "y"))
    rows += [(7, "same same", "a", "x", "y")] * 3 + [(None, "no id\tat\x0ball here", None, "x", "y"), (n, "long " * 20000, "a", "x", "y")]
    return rows


def test_word_count(spark):
    texts = ["", " ", "a", " a  b\t\n\x0b\x0c\rc ", "a\u00a0b", "\u2003", "x\x1cy z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_mix_holds_its_promises(spark):
    rows = made(3)
    df = table(spark, rows)
    got = mixing.mix(df, shard_words=5000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        shards = len({r["shard"] for r in got if r["source"] == s})
        assert abs(taken[s] - target[s]) <= got[0]["block_words"] * (2 + 2 * shards), s
    again = mixing.mix(df.repartition(5), shard_words=5000).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"], r["shard"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_highest_quotients(spark):
    r = random.Random(5)
    for _ in range(12):
        votes = [r.choice([0.0, 1.0, 3.0, 3.0, 50.0, 1000.0 * r.random()]) for _ in range(r.randint(1, 9))]
        caps = [r.randint(0, 40) for _ in votes]
        seats = r.randint(0, max(0, min(60, sum(caps) // 4)))
        df = spark.createDataFrame([(1, i, v, seats, c) for i, (v, c) in enumerate(zip(votes, caps, strict=True))], "g int, p int, v double, s long, c long")
        got = {x["p"]: x["won"] for x in mixing.sainte_lague(df, ["g"], "p", "v", "s", "c", "won").collect()}
        heap, won = [(-v, i) for i, v in enumerate(votes) if v > 0 and caps[i]], [0] * len(votes)
        heapq.heapify(heap)
        for _ in range(seats):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            won[i] += 1
            if won[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
        assert [got[i] for i in range(len(votes))] == won, (votes, caps, seats)


def test_stage_repeats_documents_near_their_targets(spark):
    rows = [(i, "w " * 50, f"s{i % 3}", "x", "y") for i in range(900)]
    df = table(spark, rows).withColumn("row_hash", F.lit(1)).withColumn("shard", F.lit("own"))
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    counts = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = plain_targets({f"s{k}": 15000 for k in range(3)})
    assert all(abs(counts[s] * 50 - target[s]) < 0.1 * target[s] for s in counts)


def test_stage_keeps_the_plan_for_repeated_rows(spark):
    rows = [(1, "w " * 50, f"s{k}", f"n{i % 5}", "y") for k in range(3) for i in range(300)]
    df = table(spark, rows)
    plan = mixing.mix(df).groupBy("source").agg((F.sum("taken") / 50).alias("n")).collect()
    counts = {r["source"]: r["n"] for r in mixing.stage(spark, df, "").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(counts.get(r["source"], 0) - r["n"]) <= 0.1 * r["n"] + 2 for r in plan), (plan, counts)


def test_groups_of_shards(spark):
    rows = [(i, "w " * (i % 90), f"s{i % 2}", "x", "y") for i in range(1500)]
    df = table(spark, rows)
    got = mixing.mix(df, shard_words=300, group_shards=8).collect()
    taken, target, shards = Counter(), {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        shards.setdefault(r["source"], set()).add(r["shard"])
    assert min(map(len, shards.values())) > 50
    for s in target:
        assert abs(taken[s] - target[s]) <= got[0]["block_words"] * (2 + 2 * len(shards[s]))
        assert abs(taken[s] - target[s]) <= 0.03 * target[s]


def test_empty(spark):
    assert mixing.stage(spark, table(spark, []), "").count() == 0
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [(1, None, None, "", "")])).collect()[0]["taken"] == 0


def plain_seats(votes, caps, seats):
    """Highest quotients one at a time; ties to the earlier party."""
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    heapq.heapify(heap)
    won = [0] * len(votes)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def test_words_taken_of_every_document_equal_a_plain_deal(spark):
    df = table(spark, made(8, 400))
    got = mixing.mix(df, shard_words=2500, group_shards=4).collect()
    width = got[0]["block_words"]
    order = sorted({r["source"] for r in got}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    size = {s: sum(r["size"] for r in got if r["source"] == s) for s in order}
    target = plain_targets(size)
    blocks = plain_seats([target[s] for s in order], [2 * -(-size[s] // width) for s in order], round(sum(target.values()) / width))
    for number, source in enumerate(order):
        shards = {}
        for r in got:
            if r["source"] == source:
                shards.setdefault(r["shard"], []).append(r)
        names = sorted(shards)
        words = {k: sum(r["size"] for r in shards[k]) for k in names}
        cap = {k: 2 * -(-words[k] // width) for k in names}
        groups = sorted({k // 4 for k in names})
        inside = {g: [k for k in names if k // 4 == g] for g in groups}
        of_group = plain_seats([sum(words[k] for k in inside[g]) for g in groups], [sum(cap[k] for k in inside[g]) for g in groups], blocks[number])
        for g, won in zip(groups, of_group, strict=True):
            quota = plain_seats([words[k] for k in inside[g]], [cap[k] for k in inside[g]], won)
            for k, q in zip(inside[g], quota, strict=True):
                n = max(1, -(-words[k] // width))
                start = spark.range(1).select(F.pmod(F.xxhash64(F.lit(mixing.SEED + 2), F.lit(number), F.lit(k).cast("long")), F.lit(n))).first()[0]
                at = 0
                for r in sorted(shards[k], key=lambda r: (r["row_hash"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"])):
                    taken = 0
                    for b in range(at // width, -(-(at + r["size"]) // width)):
                        part = min(at + r["size"], (b + 1) * width) - max(at, b * width)
                        taken += part * (q // n + ((b * (2_971_215_073 % n) + start) % n < q % n))
                    assert r["taken"] == taken, (source, k, r)
                    at += r["size"]
