"""Token counts with a whole-token shortcut for a byte-level BPE vocabulary.

Offline, that is once on the driver, every vocabulary string is merged on its
own; those that end as one token are proven whole, and their set, bounded by
the vocabulary, is broadcast.  A pre-token among them counts as one without any
merging; only the rest goes through the merge table.  Null texts count as
empty (0 bytes, 0 tokens).  Special token strings count as one token each.
Repeated rows give repeated results, an empty table none; a null or repeated id
is carried as it is, and other columns play no part.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import code_points, pair_index
from latticework.llm.runtime import table, text_or_empty

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens whose counts a worker keeps; at this many the older ones make room, results are the same.
KEPT_WORDS = 300_000
LIMIT = 1024


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def proven(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as exactly their own token."""
    index, _ = pair_index.load(path)
    back = {c: b for b, c in enumerate(pair_index.byte_alphabet())}
    items = [(i, bytes(back[c] for c in t)) for i, t in index.tokens.items() if all(c in back for c in t)]
    found = set()
    for (i, raw), ids in zip(items, index.encode([raw for _, raw in items]), strict=True):
        if ids == [i]:
            try:
                found.add(raw.decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a pre-token
    return frozenset(found)


class TokenCounter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.index, self.special = pair_index.load(path)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.library = code_points.Library(path)
        self.whole = whole
        self.extra: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def odd_split(self, text: str) -> list[str]:
        """Pre-tokens of a text with odd code points."""
        return self.library.split(PRE_TOKENS, text)

    def pre_tokens(self, text: str, split=PRE_TOKENS.findall) -> tuple[list[str], int]:
        if self.marks is None or "<" not in text:
            return split(text), 0
        parts = self.marks.split(text)
        out: list[str] = []
        for part in parts:
            out.extend(split(part))
        return out, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        whole, out, rest = self.whole, [], []
        odd = code_points.odd(texts)
        for i, text in enumerate(texts):
            words, marks = self.pre_tokens(text, self.odd_split) if i in odd else self.pre_tokens(text)
            out.append(len(words) + marks)
            rest.append([w for w in words if w not in whole])
        need = set().union(*rest) if rest else set()
        if len(self.extra) + len(need) > KEPT_WORDS:
            self.extra, self.older = {}, self.extra
        extra, older, new = self.extra, self.older, []
        for w in need:
            if w not in extra:
                if w in older:
                    extra[w] = older[w]
                else:
                    new.append(w)
        for w, ids in zip(new, self.index.encode([w.encode() for w in new]), strict=True):
            extra[w] = len(ids) - 1
        return [n + sum([extra[w] for w in ws]) for n, ws in zip(out, rest, strict=True)]


_COUNTERS: dict[str, TokenCounter] = {}


def worker_counter(path: str, whole: frozenset[str]) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path, whole)
    return _COUNTERS[path]


#: Texts counted together; bounds what a worker holds.
BATCH_TEXTS = 512


def count_tokens(df: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    typed = dict(df.dtypes)[id_column]
    whole = df.sparkSession.sparkContext.broadcast(proven(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path, whole.value)
        gc.disable()  # only long-lived tables and lists without cycles are made here
        try:
            for b in batches:
                for at in range(0, b.num_rows, BATCH_TEXTS):
                    part = b.slice(at, BATCH_TEXTS)
                    n = pa.array(counter.count(part.column(2).to_pylist()), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n], [id_column, "n_bytes", "n_tokens"])
        finally:
            gc.enable()

    text = text_or_empty(text_column)
    rows = df.select(df[id_column], F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, f"`{id_column}` {typed}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
