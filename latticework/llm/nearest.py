"""Approximate nearest neighbours over balanced posting lists.

Centroids come from halving a bounded sample again and again at the median, so
lists hold about equally many vectors.  Every vector is indexed; one near a
boundary is replicated to the lists whose centroids are nearly as close.  A query walks a neighbour graph over the
centroids, held in memory, and takes every list within a ratio of the nearest
centroid's distance (more, where those hold too few vectors).  The ratio is set
on the sample, by the recall it gives there.  Distances are
computed on the original vectors in double precision.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without vec_id or of another than the most frequent length
(ties: the smaller length).  Rows with the same vec_id count as one candidate,
the nearest of them; a row with the query's own vec_id is none.  Ties go to the
smaller vec_id.  An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latticework.llm.runtime import stored, table

#: Vectors that the centroids are made from, at most.
SAMPLE = 20_000
#: Vectors of a list, about, and lists at most: the centroids' size is bounded by it.
LIST_SIZE = 512
MAX_LISTS = 4096
#: A vector goes to each list within this ratio of its nearest centroid, at most so many.
CLOSURE, REPLICAS = 1.03, 4
#: A query takes each list within a ratio of its nearest centroid: the least of these that finds
#: so large a share of the true neighbours of some sampled vectors within the sample.
PROBES = (1.02, 1.05, 1.08, 1.1, 1.15, 1.2, 1.3, 1.5, 2.0, 4.0, float("inf"))
WANTED_RECALL, TRIALS = 0.97, 200
DEGREE = 16
#: Lists (neighbours by number, and so in space) that a task searches together, and vectors of them in one task.
SHELF = 16
SALT_ROWS = 8192
#: Queries of one part that a task holds, about.
HEAP_ROWS = 8192
K = 10


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))


@dataclass(frozen=True)
class Centroids:
    points: np.ndarray
    links: np.ndarray

    def search(self, q: np.ndarray, ratio: float, sizes: np.ndarray | None = None, enough: int = 0) -> list[int]:
        """Lists within ``ratio`` of the nearest centroid, nearest first, and on until they hold ``enough`` vectors."""
        far = lambda ids: np.sqrt(((self.points[ids] - q) ** 2).sum(1))
        start = np.unique(np.linspace(0, len(self.points) - 1, num=min(8, len(self.points))).astype(int))
        seen = set(start.tolist())
        heap = list(zip(far(start).tolist(), start.tolist(), strict=True))
        heapq.heapify(heap)
        best, taken, held, slack = heap[0][0], [], 0, 2 * DEGREE
        if ratio == float("inf"):
            enough = int(sizes.sum()) + 1 if sizes is not None else 1 << 62
            ratio = 1e300
        while heap:
            d, i = heapq.heappop(heap)
            if d > best * ratio and len(taken) >= slack and held >= enough:
                break
            best = min(best, d)
            taken.append((d, i))
            held += int(sizes[i]) if sizes is not None else 0
            new = [j for j in self.links[i].tolist() if j not in seen]
            if new:
                seen.update(new)
                for e, j in zip(far(new).tolist(), new, strict=True):
                    heapq.heappush(heap, (e, j))
        if held < enough and len(taken) < len(self.points):  # not all centroids could be reached
            rest = np.setdiff1d(np.arange(len(self.points)), [i for _, i in taken])
            taken += list(zip(far(rest).tolist(), rest.tolist(), strict=True))
        taken.sort()
        out, held = [], 0
        for d, i in taken:
            if d > best * ratio and held >= enough:
                break
            out.append(i)
            held += int(sizes[i]) if sizes is not None else 0
        return out


def halved(points: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Means of groups of at most ``size`` points, each group cut in halves along its two-means axis."""
    rng, todo, out = np.random.default_rng(seed), [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= max(1, size):
            out.append(points[own].mean(0))
            continue
        x = points[own]
        two = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = ((x - two[0]) ** 2).sum(1) > ((x - two[1]) ** 2).sum(1)
            if side.all() or not side.any():
                break
            two = np.stack([x[~side].mean(0), x[side].mean(0)])
        order = np.argsort(x @ (two[1] - two[0]), kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return np.array(out)


def build(sample: np.ndarray, lists: int) -> Centroids:
    """Centroids and their neighbour graph: the nearest of each, links both ways, and a ring over all."""
    points = halved(sample, max(1, round(len(sample) / lists)))
    n = len(points)
    links: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 256):
        part = points[at : at + 256]
        d = (part**2).sum(1)[:, None] - 2 * part @ points.T + (points**2).sum(1)[None]
        near = np.argsort(d, 1)[:, : DEGREE + 1]
        for i, row in enumerate(near, at):
            for j in row.tolist():
                if j != i:
                    links[i].add(j)
                    links[j].add(i)
    for i in range(n):
        links[i] |= {(i + 1) % n, (i + n // 2) % n} - {i}
    width = max((len(s) for s in links), default=1) or 1
    table_ = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(links)], np.int32).reshape(n, width)
    return Centroids(points, table_)


def assign(x: np.ndarray, c: Centroids) -> list[list[int]]:
    """Lists of each vector: the nearest, and the others within the closure ratio."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.points.T + (c.points**2).sum(1)[None], 0))
    few = min(REPLICAS, len(c.points))
    near = np.argpartition(d, few - 1, 1)[:, :few]
    at = np.take_along_axis(d, near, 1)
    ok = at <= np.maximum(CLOSURE * at.min(1, keepdims=True), at.min(1, keepdims=True))
    return [row[keep].tolist() for row, keep in zip(near, ok, strict=True)]


def calibrated(sample: np.ndarray, c: Centroids, k: int) -> float:
    """The least probe ratio that finds WANTED_RECALL of the sampled vectors' ``k`` nearest in the sample."""
    lists = np.zeros((len(sample), len(c.points)), bool)
    for at in range(0, len(sample), 1024):
        for i, own in enumerate(assign(sample[at : at + 1024], c), at):
            lists[i, own] = True
    trials = np.linspace(0, len(sample) - 1, num=min(TRIALS, len(sample))).astype(int)
    found = np.zeros(len(PROBES))
    wanted = 0
    for t in trials:
        d = ((sample - sample[t]) ** 2).sum(1)
        d[t] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        to = np.sqrt(((c.points - sample[t]) ** 2).sum(1))
        first = np.where(lists[near], to[None], np.inf).min(1)  # the nearest centroid that has each neighbour
        found += [np.isfinite(first).sum() if r == float("inf") else (first <= to.min() * r).sum() for r in PROBES]
        wanted += len(near)
    good = [r for r, f in zip(PROBES, found, strict=True) if f >= WANTED_RECALL * wanted]
    return good[0]


def sampled(rows: DataFrame, n: int) -> np.ndarray:
    """Up to ``SAMPLE`` vectors, those with the least hashes; a bound on the hash leaves about twice as many to be sorted."""
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    some = rows.filter(place < F.lit(max(1, min(1 << 40, 2 * SAMPLE * (1 << 40) // n)))) if n > 2 * SAMPLE else rows
    picked = some.orderBy(place, "vec_id", "v").limit(SAMPLE).select("v").collect()
    if not picked:  # so few ids that the bound leaves none
        picked = rows.orderBy(place, "vec_id", "v").limit(SAMPLE).select("v").collect()
    return np.array([r["v"] for r in picked])


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(df: DataFrame, k: int = K, every: int = 100, probe: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every``, against all rows."""
    rows = usable(df)
    spark = df.sparkSession
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = sampled(rows, n)
    centroids = build(sample, min(MAX_LISTS, max(1, -(-n // LIST_SIZE))))
    probe = calibrated(sample, centroids, k) if probe is None else probe

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                lists = assign(matrix(part.column(1)), centroids)
                back = pa.array(np.repeat(np.arange(part.num_rows), [len(s) for s in lists]))
                yield pa.RecordBatch.from_arrays([pa.array([i for s in lists for i in s], pa.int32()), part.column(0).take(back), part.column(1).take(back)], ["list", "vec_id", "v"])

    postings = stored(rows.mapInArrow(post, "list int, vec_id long, v array<double>"))
    counted = postings.groupBy("list").count().collect()  # one row for each list, at most MAX_LISTS
    sizes = np.zeros(len(centroids.points), np.int64)
    for r in counted:
        sizes[r["list"]] = r["count"]
    shelves = np.add.reduceat(sizes, np.arange(0, len(sizes), SHELF))
    salts = np.maximum(1, -(-shelves // SALT_ROWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows_of = []
                for k_, q in enumerate(matrix(part.column(1))):
                    asked: dict[int, list[int]] = {}
                    for i in centroids.search(q, probe, sizes, 8 * k * REPLICAS):
                        asked.setdefault(i // SHELF, []).append(i)
                    rows_of += [(shelf, s, k_, lists) for shelf, lists in asked.items() for s in range(salts[shelf])]
                back = pa.array([r[2] for r in rows_of], pa.int32())
                cols = [pa.array([r[0] for r in rows_of], pa.int32()), pa.array([r[1] for r in rows_of], pa.int32()), part.column(0).take(back), part.column(1).take(back), pa.array([r[3] for r in rows_of], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["shelf", "salt", "query_id", "q", "lists"])

    queries = stored(rows.filter(F.col("vec_id") % every == 0).mapInArrow(ask, "shelf int, salt int, query_id long, q array<double>, lists array<int>"))
    # queries of one part of a shelf are searched some at a time, each time with the part's vectors
    heaps = np.ones(len(shelves), np.int64)
    for r in queries.filter("salt = 0").groupBy("shelf").count().collect():
        heaps[r["shelf"]] = -(-r["count"] // HEAP_ROWS)
    of_shelf = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("shelf") + 1)
    queries = queries.withColumn("heap", F.pmod(F.xxhash64("query_id"), of_shelf(heaps)).cast("int"))
    shelved = postings.withColumn("shelf", F.floor(F.col("list") / SHELF).cast("int"))
    salted = shelved.withColumn("salt", F.pmod(F.xxhash64("vec_id"), of_shelf(salts)).cast("int"))
    salted = salted.withColumn("heap", F.explode(F.sequence(F.lit(0), of_shelf(heaps - 1).cast("int"))))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` nearest of one part of a shelf to each query that asks for lists of it."""
        out = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})]
        if len(left) and len(right):
            x, ids, own = np.stack(left["v"].to_numpy()), left["vec_id"].to_numpy(), left["list"].to_numpy()
            for query, q, lists in zip(right["query_id"], right["q"], right["lists"], strict=True):
                at = np.flatnonzero(np.isin(own, lists) & (ids != query))
                d = np.sqrt(((x[at] - q) ** 2).sum(1))
                order = np.lexsort((ids[at], d))
                _, first = np.unique(ids[at][order], return_index=True)  # a vector of several lists counts once
                best = order[np.sort(first)[:k]]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][best], "score": d[best]}))
        return pd.concat(out)

    part = salted.groupBy("shelf", "salt", "heap").cogroup(queries.groupBy("shelf", "salt", "heap")).applyInPandas(near, "query_id long, vec_id long, score double")
    one = part.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_nearest": op5_nearest}
SQL: dict[str, str] = {}
