"""Document fingerprints by locally consistent parsing, and the likeness of neighbours.

Documents stand in descending doc_id (nulls last, equal ids by the hash of the
text); the next one after the last is the first.  Null texts count as empty.
Equal texts have equal fingerprints; the fingerprint of an empty text is empty.
A table of one row is its own neighbour; an empty table gives no rows; other
columns play no part.  Rows without an id, or with a frequent one, are dealt
over tasks by the hash of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import phrases
from latticework.llm.runtime import table, text_or_empty

#: Characters whose phrases are named together; a longer text stands alone.
BATCH_CHARS = 400_000
#: Buckets of neighbouring ids for each shuffle partition, so that partitions come out even.
BUCKETS = 4
#: Rows of one partition, about, where there are more than the session's partitions would hold.
PARTITION_ROWS = 250_000


def constant_array(values: list[int]) -> Column:
    """An array of longs as one folded literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def position(values: list[int], x: Column) -> Column:
    """How many of the descending ``values`` are >= x, by binary search."""
    if not values:
        return F.lit(0)
    a, steps = constant_array(values), len(values).bit_length() + 1
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(values)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        more = F.element_at(a, F.least(mid + 1, F.lit(len(values)))) >= x
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & more, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~more, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def packed(rows: DataFrame) -> DataFrame:
    """doc_id, tie (the text's hash), and the text compressed: a third less to shuffle than Spark's own codec leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack(t.encode()) for t in part.column(2).to_pylist()], pa.binary())], ["doc_id", "tie", "text"])

    return rows.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, text binary")


def neighboured(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id, text (compressed), guest: sorted by descending id inside buckets of neighbouring ids.

    Each bucket ends with a guest, the first document of the next bucket, so
    every text is shuffled once and no task sees more than its buckets.  A
    bucket of one id (or of none) that is larger than others is cut again by
    the hashes of its texts.  Only the limits of the buckets reach the driver,
    as many as there are partitions times ``BUCKETS``.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total = ids.count()
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(own, -(-total // PARTITION_ROWS))
    n = max(own * BUCKETS, partitions)
    cuts = ids.filter("doc_id is not null").select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    often = [int(a) for a, b in zip(cuts, cuts[1:], strict=False) if a == b]  # an id of so many rows gets a bucket of its own
    limits = sorted({int(c) for c in cuts} | {c - 1 for c in often}, reverse=True)
    band = F.when(F.col("doc_id").isNull(), len(limits) + 1).otherwise(position(limits, F.col("doc_id"))).cast("int")
    known = len(limits) + 2
    facts = {r["band"]: r for r in ids.withColumn("band", band).groupBy("band").agg(F.max("doc_id").alias("head"), F.min("doc_id").alias("foot"), F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, -(-facts[b]["n"] * n // (2 * total))) if b in facts and facts[b]["head"] == facts[b]["foot"] else 1 for b in range(known)]
    first = [sum(parts[:b]) for b in range(known)]

    rows = packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))

    def dealt(rows: DataFrame) -> DataFrame:
        """Bands, and buckets in the order of the hashes inside a band that is cut."""
        share = (F.col("tie").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
        at, width = F.element_at(constant_array(first), F.col("band") + 1), F.element_at(constant_array(parts), F.col("band") + 1)
        return rows.withColumn("band", band).withColumn("bucket", (at + F.least(F.floor(share * width), width - 1)).cast("int"))

    split = [b for b in range(known) if parts[b] > 1]
    tie = {b: None for b in range(sum(parts))}
    filled = {first[b] for b in facts if parts[b] == 1}
    if split:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"))
        for r in dealt(texts).filter(F.col("band").isin(*split)).groupBy("bucket").agg(F.min("tie").alias("tie")).collect():
            tie[r["bucket"]] = r["tie"]
            filled.add(r["bucket"])
    order = sorted(filled)
    before = {b: a for a, b in zip(order, order[1:], strict=False)}
    rows = dealt(rows)
    places = range(sum(parts))
    heads = [facts[b]["head"] if b in facts and facts[b]["head"] is not None else -1 for b in range(known)]
    of_bucket = lambda values: F.element_at(constant_array(values), F.col("bucket") + 1)
    is_head = (F.element_at(constant_array(heads), F.col("band") + 1) == F.col("doc_id")) | F.col("doc_id").isNull()
    is_head &= (of_bucket([int(tie[b] is not None) for b in places]) == 0) | (of_bucket([tie[b] or 0 for b in places]) == F.col("tie"))
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail"), F.lit(False).alias("guest"))
    guest = F.struct(of_bucket([before.get(b, -1) for b in places]).cast("int").alias("bucket"), F.lit(1).alias("tail"), F.lit(True).alias("guest"))
    wrap = F.struct(F.lit(order[-1] if order else -1).alias("bucket"), F.lit(1).alias("tail"), F.lit(True).alias("guest"))
    seats = F.concat(
        F.array(home),
        F.when(is_head & (guest["bucket"] >= 0), F.array(guest)).otherwise(F.array().cast("array<struct<bucket:int,tail:int,guest:boolean>>")),
        F.when(is_head & (F.col("bucket") == F.lit(order[0] if order else -1)), F.array(wrap)).otherwise(F.array().cast("array<struct<bucket:int,tail:int,guest:boolean>>")),
    )
    seated = rows.select("doc_id", "text", "tie", F.explode(seats).alias("seat")).select("seat.*", "doc_id", "text", "tie")
    return seated.repartition(partitions, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "tie")


def fingerprinted(docs: DataFrame, keep_edited: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; with ``keep_edited`` the edited text."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")] + ["edited"] * keep_edited

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        """Rows but the last, each with the one after it as its neighbour."""
        texts = [r[2] for r in rows]
        own = [i for i in range(len(rows) - 1) if not rows[i][3]]
        edited = []
        for i in own:
            k = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
        marks = phrases.sketches(texts + edited)
        out = []
        for j, i in enumerate(own):
            mine, other, changed = marks[i], marks[i + 1], marks[len(texts) + j]
            got = (rows[i][1], len(texts[i]), hashlib.sha256(edited[j].encode()).hexdigest(), phrases.written(mine), phrases.written(changed), phrases.likeness(mine, changed), phrases.likeness(mine, other))
            out.append(got + ((edited[j],) if keep_edited else ()))
        if not out:
            return None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars, unpack = 0, zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = (row[0], row[1], unpack(row[2]).decode() if row[2] else "", row[3])
                held.append(row)
                chars += len(row[2])
                if chars > BATCH_CHARS and len(held) > 1:
                    if (out := work(held)) is not None:
                        yield out
                    held = held[-1:]
                    chars = len(held[0][2])
        if len(held) > 1 and (out := work(held)) is not None:
            yield out

    return neighboured(docs).select("bucket", "doc_id", "text", "guest").mapInArrow(run, schema + ", edited string" * keep_edited)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
SQL: dict[str, str] = {}
