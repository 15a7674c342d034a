"""Ordinal cumulative-link regression on hashed text: expected grade and tail probabilities.

Grades come from the labels table: 0 for poor quality, 1 for good but toxic,
2 for good.  One weight vector over hashed words, word shapes and immediate repeats is
shared by all grades; ordered thresholds turn the score s into
P(grade >= k) = 1 / (1 + exp(threshold[k] - s)).

Fitted on at most ``SAMPLE`` labelled documents, chosen by the hash of their
ids (of rows that share an id, the text with the least hash); every document is
scored on its whole text.  Null texts count as empty; a text without words has
score 0 of its own.  Repeated rows and null ids are scored like any; an empty
table gives no rows; other columns play no part.  Of equal scores none is
preferred: a document is kept by its own probability alone.  Labels without quality are
ignored, a null toxic counts as 0; with fewer than two grades labelled, every
document gets the one known grade (the best where none is known) and is kept.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.runtime import table, text_or_empty

BITS = 16
#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 4000
GRADES = 3
#: A document is kept where P(grade >= 1) reaches this.
KEEP_AT = 0.5
KEPT_WORDS = 100_000

SHAPES = (
    (re.compile(r"[0-9]+"), "9"),
    (re.compile(r"[^\W\d_]+"), lambda m: "a" if (w := m[0]).islower() else "A" if w.isupper() and len(w) > 1 else "Aa" if w[:1].isupper() and w[1:].islower() else "aA"),
    (re.compile(r"([^\w\s])\1+"), r"\1\1"),
)


def shape(word: str) -> str:
    """A word's outline: case of its letter runs, digits as 9, marks (runs of one mark as two)."""
    for pattern, by in SHAPES:
        word = pattern.sub(by, word)
    return word


def features(word: str) -> tuple[int, int]:
    """Hashed features of one word: the lower-cased word and its shape."""
    mask = (1 << BITS) - 1
    return zlib.crc32(b"w" + word.lower().encode()) & mask, zlib.crc32(b"s" + shape(word).encode()) & mask


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: tuple[float, ...]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., one column each."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - scores[:, None], -60, 60)))


#: Feature of words that repeat the word before them.
REPEAT = zlib.crc32(b"repeat") & ((1 << BITS) - 1)


def repeats(words: list[str]) -> int:
    return sum(map(operator.eq, words, words[1:]))


def sparse(text: str) -> tuple[list[int], list[float]]:
    """Mean hashed feature counts of a text."""
    words = text.split()
    found: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for i in features(w):
            found[i] += n
    found[REPEAT] += repeats(words)
    scale = 1 / max(len(words), 1)
    return list(found), [v * scale for v in found.values()]


def fit(grades: np.ndarray, indices: list[np.ndarray], values: list[np.ndarray], steps: int = 250, rate: float = 0.3, decay: float = 1e-5) -> OrdinalModel:
    """Adam on the cumulative-link likelihood; thresholds stay ordered as a base and positive steps."""
    known = np.unique(grades)
    if len(known) < 2:
        best = int(known[0]) if len(known) else GRADES - 1
        return OrdinalModel(np.zeros(1 << BITS), tuple(-30.0 if k <= best else 30.0 for k in range(1, GRADES)))
    n = len(grades)
    rows = np.repeat(np.arange(n), [len(i) for i in indices])
    cols, vals = np.concatenate(indices), np.concatenate(values)
    above = np.stack([grades >= k for k in range(1, GRADES)], 1).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    params = np.concatenate((np.zeros(1 << BITS), [first[0]], np.log(np.maximum(np.diff(first), 0.05))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, base, gaps = params[: 1 << BITS], params[1 << BITS], np.exp(params[(1 << BITS) + 1 :])
        theta = base + np.concatenate(([0.0], np.cumsum(gaps)))
        s = np.bincount(rows, w[cols] * vals, n)
        tail = 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -60, 60)))
        # cell probabilities, and each one's derivative by score and by threshold
        full = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), 1)
        slope = np.concatenate((np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))), 1)
        at = grades.astype(int)
        i = np.arange(n)
        p = np.maximum(full[i, at] - full[i, at + 1], 1e-9)
        ds = -(slope[i, at] - slope[i, at + 1]) / p / n
        dtheta = np.zeros(GRADES - 1)
        for k in range(1, GRADES):
            dtheta[k - 1] = (slope[:, k] * ((at == k) * 1.0 - (at + 1 == k) * 1.0) / p).sum() / n
        grad = np.concatenate((np.bincount(cols, ds[rows] * vals, 1 << BITS) + decay * w, [dtheta.sum()], [dtheta[k:].sum() * gaps[k - 1] for k in range(1, GRADES - 1)]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = params[1 << BITS] + np.concatenate(([0.0], np.cumsum(np.exp(params[(1 << BITS) + 1 :]))))
    return OrdinalModel(params[: 1 << BITS].astype(np.float32), tuple(float(t) for t in theta))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: one row per labelled document."""
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) >= 1, 1).otherwise(2)
    return labels.filter("doc_id is not null and quality is not null").select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on a bounded sample; only the sampled rows are broadcast and only their hashed counts reach the driver."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = text_or_empty()
    rows = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("one")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("one").alias("one"), F.first("grade").alias("grade")).select(F.col("one.text").alias("text"), "doc_id", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sparse(t) for t in b.column(0).to_pylist()]
            cols = [b.column(1), b.column(2), pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "grade", "i", "v"])

    found = rows.mapInArrow(run, "doc_id long, grade int, i array<int>, v array<float>").collect()  # ``sample`` rows at most
    found = sorted(found, key=lambda r: r["doc_id"])
    return fit(np.array([r["grade"] for r in found], int), [np.array(r["i"], np.int64) for r in found], [np.array(r["v"], float) for r in found])


def score(docs: DataFrame, model: OrdinalModel, carry: tuple[str, ...] = ("doc_id",), keep_at: float = KEEP_AT, inside: str | None = None) -> DataFrame:
    """``carry`` columns, then score, expected_grade, p_grade_1, p_grade_2 and keep, for every whole text.

    The text is column ``text``, or field ``text`` of the carried struct ``inside``.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", score double"
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        w = weights.tolist()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                texts = part.column(carry.index(inside)).field("text") if inside else part.column(len(carry))
                for text in texts.to_pylist():
                    words = (text or "").split()
                    try:
                        total = sum([kept[x] for x in words])
                    except KeyError:
                        if len(kept) > KEPT_WORDS:
                            kept.clear()
                        for x in set(words):
                            if x not in kept:
                                i, j = features(x)
                                kept[x] = w[i] + w[j]
                        total = sum([kept[x] for x in words])
                    out.append((total + w[REPEAT] * repeats(words)) / max(len(words), 1))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(out, pa.float64())], [*carry, "score"])

    scored = docs.select(*[docs[c] for c in carry], *([] if inside else [text_or_empty().alias("__text")])).mapInArrow(run, schema)
    tails = [1 / (1 + F.exp(F.lit(t) - F.col("score"))) for t in model.thresholds]
    out = scored.select(*carry, "score", sum(tails[1:], tails[0]).alias("expected_grade"), *[t.alias(f"p_grade_{k}") for k, t in enumerate(tails, 1)])
    return out.withColumn("keep", F.col("p_grade_1") >= keep_at)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the documents that the classifier rejects; columns as given."""
    model = train(docs, table(spark, sf_dir, "labels"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    return score(row, model, carry=("__row",), inside="__row").filter("keep").select("__row.*")


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
