"""BPE encoding and decoding of whole texts with a lower-casing, word-end vocabulary.

Null texts count as empty.  Empty and blank texts give no ids and an empty
decoded text.  Special token strings inside a text become their own ids.
Repeated rows give repeated results, an empty table none; a null or repeated id
is carried as it is, and other columns play no part.
"""

from __future__ import annotations

import gc
import hashlib
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from latticework.llm import code_points, pair_index
from latticework.llm.runtime import table, text_or_empty

#: Fixed value: the pre-token pattern of the vocabulary file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Distinct words whose ids a worker keeps; at this many the older ones make room, results are the same.
KEPT_WORDS = 220_000
#: Texts taken from an Arrow batch at a time.
BATCH_TEXTS = 1000
#: Characters of text whose new words are merged together.
BATCH_CHARS = 2_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def normalise(text: str) -> str:
    """Canonical composition, lower case letter by letter; white space stays, as no pre-token holds any."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # no special case for a final sigma
    return text.lower()


class WordCoder:
    """Encodes and decodes texts; new words of a batch go through the pair index together."""

    def __init__(self, path: str):
        self.index, self.special = pair_index.load(path)
        self.by_id = self.index.tokens | {i: t for t, i in self.special.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.library = code_points.Library(path)

    def odd_split(self, text: str) -> list[str]:
        """Pre-tokens of a text with odd code points, in the forms that the library's normaliser gives them."""
        return self.library.split(WORDS, self.library.normalised(text))

    def words(self, text: str, split=lambda text: WORDS.findall(normalise(text))) -> list[str]:
        """Pre-tokens; a special token is marked by two leading NULs and its own name."""
        if self.marks is None or "<|" not in text:
            return split(text)
        out: list[str] = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append("\0\0" + part)
            elif part:
                out.extend(split(part))
        return out

    def packed(self, ids: list[int]) -> bytes:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def unpacked(self, ids: bytes) -> array:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces: the vocabulary file names no decoder."""
        return " ".join(map(self.by_id.__getitem__, ids))

    def unknown(self, words: set[str]) -> list[str]:
        """Words without kept ids.  Of the words kept before the last turn-over, those in use move on."""
        if len(self.kept) + len(words) > KEPT_WORDS:
            self.kept, self.older = {}, self.kept
        kept, older, out = self.kept, self.older, []
        for w in words:
            if w not in kept:
                if w in older:
                    kept[w] = older[w]
                else:
                    out.append(w)
        return out

    def learn(self, new: list[str]) -> None:
        kept, plain = self.kept, []
        for w in new:
            if w[:2] == "\0\0" and w[2:] in self.special:
                kept[w] = self.packed([self.special[w[2:]]])
            else:
                plain.append(w)
        for w, ids in zip(plain, self.index.encode([w.encode() for w in plain]), strict=True):
            kept[w] = self.packed(ids)

    def code(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(packed ids, decoded text) of each text."""
        at = 0
        while at < len(texts):
            first, chars = at, 0
            while at < len(texts) and (at == first or chars < BATCH_CHARS):
                chars += len(texts[at])
                at += 1
            group = texts[first:at]
            odd = code_points.odd(group)
            lists = [self.words(t, self.odd_split) if i in odd else self.words(t) for i, t in enumerate(group)]
            self.learn(self.unknown(set().union(*lists)))
            kept = self.kept
            for ws in lists:
                ids = b"".join([kept[w] for w in ws])
                yield ids, self.decode(self.unpacked(ids))


def code_column(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode, then decode, every whole text.

    Returns the id column, n_tokens, ids_sha256 and decoded_sha256; with
    ``keep_ids`` also token_ids (array of int) and decoded (the text).
    """
    typed = dict(df.dtypes)[id_column]
    schema = f"`{id_column}` {typed}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", token_ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path)
        gc.disable()  # only long-lived tables and lists without cycles are made here
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH_TEXTS):
                    yield coded(coder, whole.slice(at, BATCH_TEXTS))
        finally:
            coder.older = {}
            gc.enable()

    def coded(coder: WordCoder, b: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(coder.code(b.column(1).to_pylist()))
        cols = [
            b.column(0),
            pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in rows], pa.string()),
        ]
        names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols += [pa.array([list(coder.unpacked(i)) for i, _ in rows], pa.list_(pa.int32())), pa.array([t for _, t in rows], pa.string())]
            names += ["token_ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names)

    return df.select(df[id_column], text_or_empty(text_column).alias("text")).mapInArrow(run, schema)


_CODERS: dict[str, WordCoder] = {}


def worker_coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_column(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op3_bpe_round_trip": op3_bpe_round_trip}
SQL: dict[str, str] = {}
