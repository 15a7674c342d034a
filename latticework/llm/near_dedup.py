"""Near-duplicate classes: BagMinHash signatures, bands, and verified multiset overlap.

Texts are bags of five-word shingles; two texts are linked where the overlap of
their bags, sum of least counts over sum of greatest, is 0.8 or more, and
classes are the connected components of the links.  Equal texts are one class
before anything else, whatever their number.  Candidates are texts that share
a band; within a bucket they are compared with its most central text first,
and then only across what is still apart: a text of which too many shingles
stand in no other open text cannot be linked, and the rest are paired by a
prefix filter on their rarest shingles, so the members of a large family that
are too far from each other are told so without pairing them.

Null texts count as empty; all texts without words that are equal are one
class.  Repeated rows stay rows of their own with the same class.  A class is
named by its smallest doc_id; classes without ids are numbered downwards from
-1, or from below the least id where ids are negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm import bags
from latticework.llm.graph_components import components
from latticework.llm.runtime import cut, stored, table, text_or_empty

BANDS = 25
ROWS = 5


def text_key():
    """128-bit name of a text."""
    return F.unhex(F.md5(text_or_empty()))


def signed(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, doc_id, size (of the bag) and bands of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = bags.WordHashes()
        for b in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            for first, lists in bags.batches(b.column(2).to_pylist()):
                part = b.slice(first, len(lists))
                text, element, weight = bags.bag(lists, hashes)
                found = bags.bands(bags.bag_min_hash(text, element, weight, len(lists), n_bands * rows), rows)
                size = np.bincount(text, weight, len(lists)).astype(np.int64)
                filled = size > 0
                offsets = np.concatenate(([0], np.cumsum(np.where(filled, n_bands, 0)))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[filled].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), listed], ["key", "doc_id", "size", "bands"])

    return docs.select(text_key().alias("key"), docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "key binary, doc_id long, size long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) whose bags overlap by 0.8 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, mine = bags.WordHashes(), None, None
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            keep = []
            for key, one, other in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if key != last:
                    _, x, n = bags.bag([one.as_py().split()], hashes)
                    last, mine = key, (x, n)
                _, y, k = bags.bag([other.split()], hashes)
                inter, union = bags.overlap(mine, (y, k))
                keep.append(5 * inter >= 4 * union)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def shingles(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key, shingle, n: the bags of the texts named by ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = bags.WordHashes()
        for b in batches:
            for first, lists in bags.batches(b.column(1).to_pylist()):
                text, element, weight = bags.bag(lists, hashes)
                names = b.column(0).slice(first, len(lists)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([names, pa.array(element.view(np.int64)), pa.array(weight.astype(np.int64))], ["key", "shingle", "n"])

    return texts.join(keys, "key").select("key", "text").mapInArrow(run, "key binary, shingle long, n long")


def lonely(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key, alone: how many shingles of each text no other of these texts has."""
    counted = shingles(texts, keys).groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("key").alias("key"), F.min("n").alias("n"))
    return counted.filter("texts = 1").groupBy("key").agg(F.sum("n").alias("alone"))


def apart(rows: DataFrame, by: str) -> DataFrame:
    """Of rows (``by``, root, ...), those of a ``by`` with two roots or more, with its most frequent root as main."""
    parts = rows.groupBy(by, "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy(by).agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    # cut off, so that the join has plain shuffles on both sides and a frequent ``by`` can be split
    return rows.join(cut(mixed.select(by, F.col("main.root").alias("main"))), by)


def prefix_pairs(bags_of: DataFrame, facts: DataFrame) -> DataFrame:
    """Unordered pairs (a, b) of different roots that can overlap by 0.8.

    With the shingles of every text in one order, rarest first, all that two
    texts share stands at or after the first shingle they share; a pair is
    taken where what is left of both from a shared shingle on is enough.  The
    texts of a shingle's main root meet only those of other roots.

    Both of a pair need 9 * rest >= 4 * (own size + other's size), so the smaller
    one has a rest of 8/9 of its size: two texts with less never meet, which
    keeps a family that shares a template, but not enough of it, from pairing.
    """
    held = bags_of.join(bags_of.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")), "shingle")
    before = F.sum("n").over(Window.partitionBy("key").orderBy("texts", "shingle").rowsBetween(Window.unboundedPreceding, -1))
    left = held.withColumn("before", F.coalesce(before, F.lit(0))).filter("texts > 1").join(facts.select("key", "size", "root"), "key")
    left = left.withColumn("rest", F.col("size") - F.col("before")).filter("5 * rest >= 4 * size").select("shingle", "key", "root", "size", "rest")
    open_ = cut(apart(left, "shingle"))
    side = lambda p: open_.select(F.col("shingle").alias(f"{p}h"), F.col("key").alias(f"{p}k"), F.col("root").alias(f"{p}r"), F.col("size").alias(f"{p}s"), F.col("rest").alias(f"{p}c"), F.col("main").alias(f"{p}m"))
    fits = (F.col("xh") == F.col("yh")) & (F.col("xr") != F.col("yr")) & (9 * F.least("xc", "yc") >= 4 * (F.col("xs") + F.col("ys")))
    x, y = side("x").filter("9 * xc >= 8 * xs"), side("y")
    minor = x.filter("xr != xm").join(y, fits)
    main = x.filter("xr = xm").join(y.filter("yr != ym"), fits)
    return minor.union(main).select(F.least("xk", "yk").alias("a"), F.greatest("xk", "yk").alias("b")).distinct()


def rooted(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """doc_id, key of every row; key, rep_id (least doc_id of the text) and root (a key, one for each class) of every text."""
    rows_of = cut(signed(docs, n_bands, rows))
    reps = rows_of.groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    placed = reps.select("key", "size", "rep_id", F.explode("bands").alias("band"))
    shared = cut(placed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    inside = cut(placed.join(shared, "band"))

    centre = inside.groupBy("key").agg(F.sum("n").alias("central"), F.first("size").alias("size"), F.first("rep_id").alias("rep_id"))
    centre = cut(centre)
    source = docs.select(text_key().alias("key"), docs["doc_id"].cast("long").alias("rep_id"), text_or_empty().alias("text"))
    wanted = centre.select("key", F.col("rep_id").alias("__rep"))
    texts = source.join(wanted, (source["key"] == wanted["key"]) & source["rep_id"].eqNullSafe(wanted["__rep"])).select(source["key"], "text")
    texts = stored(texts.dropDuplicates(["key"]))

    # first the most central text of each bucket against the others
    heads = inside.select("band", "key").join(centre.select("key", "central"), "key").groupBy("band").agg(F.max(F.struct("central", "key")).alias("head"))
    star = inside.select("band", "key").join(heads.select("band", F.col("head.key").alias("a")), "band").filter("a != key")
    star = cut(star.select("a", F.col("key").alias("b")).distinct())
    links = cut(verified(star, texts))
    roots = components(links)

    # then whatever a bucket still holds apart
    parts = inside.select("band", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    still = cut(apart(parts, "band").select("band", "key", "root"))
    open_keys = still.select("key").distinct()
    alone = lonely(texts, open_keys)
    common = F.col("size") - F.coalesce("alone", F.lit(0))
    able = open_keys.join(centre.select("key", "size"), "key").join(alone, "key", "left").filter(5 * common >= 4 * F.col("size")).select("key", "size")
    facts = cut(apart(still.join(able, "key"), "band").groupBy("key").agg(F.first("size").alias("size"), F.first("root").alias("root")))
    near = prefix_pairs(cut(shingles(texts, facts.select("key"))), facts)
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(verified(cut(near.join(done, ["a", "b"], "left_anti")), texts))
    named = reps.select("key", "rep_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    if not more.isEmpty():  # links between the components found so far
        of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}r"))
        joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b"))
        over = components(joined.distinct()).select(F.col("node").alias("root"), F.col("root").alias("__over"))
        named = named.join(over, "root", "left").select("key", "rep_id", F.coalesce("__over", "root").alias("root"))
    return rows_of, cut(named)


def nameless(named: DataFrame, below: int) -> DataFrame:
    """root, number of the classes without ids: ``below`` - 1, - 2 and so on in the order of their roots.

    Classes are counted by the first two bytes of their roots, which are
    digests, so what one task sums up is 65,536 rows at most.
    """
    without = named.groupBy("root").agg(F.min("rep_id").alias("least")).filter("least is null").select("root", F.substring("root", 1, 2).alias("head"))
    ahead = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = without.groupBy("head").agg(F.count(F.lit(1)).alias("n")).select("head", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("root"))
    return without.withColumn("place", place).join(heads, "head").select("root", (F.lit(below) - F.col("before") - F.col("place")).alias("number"))


def classes(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id for every row."""
    rows_of, named = rooted(docs, n_bands, rows)
    least = named.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    if not named.filter("rep_id is null").isEmpty():
        below = min(0, named.agg(F.min("rep_id")).first()[0] or 0)
        least = least.join(nameless(named, below), "root", "left").select("root", F.coalesce("class_id", "number").alias("class_id"))
    return rows_of.select("doc_id", "key").join(named.join(least, "root").select("key", "class_id"), "key").select("doc_id", "class_id")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row stays.

    It is the one with the smallest doc_id, those without coming last; then
    the key of the text and the other columns decide.
    """
    columns = docs.columns
    _, named = rooted(docs)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "key")).alias("best"))
    keep = best.select(F.col("best.key").alias("__key"), F.col("best.rep_id").alias("__rep"))
    keyed = docs.withColumns({"__text_key": text_key(), "__id": docs["doc_id"].cast("long")})
    found = keyed.join(keep, (keyed["__text_key"] == keep["__key"]) & keyed["__id"].eqNullSafe(keep["__rep"]))
    # maps have no order of their own
    order = [F.col(c).cast("string") if "map<" in t else F.col(c) for c, t in docs.dtypes if c != "text"] + [F.col("text")]
    one = found.groupBy("__key").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in columns])


QUERIES = {"op4_near_dedup": op4_near_dedup}
SQL: dict[str, str] = {}
