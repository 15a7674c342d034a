import hashlib
import random
import sys
import unicodedata
from array import array

import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latticework.llm import bpe, pair_index, token_counts

TEXTS = ["", " \n", "hello World, it's 42!", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> <|startof", "ΑΣ ΣΑΣ Σ. straße İI ﬁ", "é x\x1c\x85\u180e\u200b y", "'S I'll don't", "a" * 5000, "١٢٣ ٤٥", "🙂👍🏽 日本語", "a\n\n  b \t c\r\n", "\0\0<|endoftext|> \0\0a", "\u0558 \u1c89b", "word " * 3000]
WORD, BYTE = Tokenizer.from_file(bpe.vocabulary_path()), Tokenizer.from_file(token_counts.vocabulary_path())
CODER, COUNTER = bpe.WordCoder(bpe.vocabulary_path()), token_counts.TokenCounter(token_counts.vocabulary_path(), token_counts.proven(token_counts.vocabulary_path()))


def check(texts):
    for t, (ids, decoded) in zip(texts, CODER.code(texts), strict=True):
        want = WORD.encode(t, add_special_tokens=False).ids
        assert list(array("I", ids)) == want, t[:80]
        assert decoded == WORD.decode(want, skip_special_tokens=False)
    assert COUNTER.count(texts) == [len(BYTE.encode(t, add_special_tokens=False).ids) for t in texts]


def test_fixed_texts():
    check(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_texts(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aabtheing '<|>", max_size=80))
def test_runs_and_overlaps(text):
    check([text])


def test_array_phase_equals_the_plain_one(monkeypatch):
    words = [w.encode() for w in {f"{a}{b}{c}" for a in ("th", "in", "aaaa", "ion") for b in ("er", "aa", "tion") for c in "abcdefgh"}]
    plain = CODER.index.encode(words)
    monkeypatch.setattr(pair_index, "ARRAY_SYMBOLS", 0)
    assert CODER.index.encode(words) == plain


def test_whole_tokens_are_proven():
    alone = [w for w in sorted(COUNTER.whole) if token_counts.PRE_TOKENS.findall(w) == [w] and w not in COUNTER.special]
    assert len(alone) > 30000 and all(len(e.ids) == 1 for e in BYTE.encode_batch(alone, add_special_tokens=False))
    assert " the" in COUNTER.whole and " zzqx" not in COUNTER.whole


def test_little_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 3)
    check(TEXTS)


def test_queries_over_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "hello there", "x"), (1, "hello there", "y"), (2, None, "z"), (None, "", "z"), (3, "word " * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.code_column(df, bpe.vocabulary_path()).collect())
    want = []
    for i, t, _ in rows:
        ids = WORD.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    counted = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, token_counts.vocabulary_path()).collect())
    lengths = [(i or 0, len((t or "").encode()), len(BYTE.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert counted == sorted((*x, x[2] > 1024) for x in lengths)
    full = bpe.code_column(df, bpe.vocabulary_path(), keep_ids=True).filter("doc_id = 1").first()
    assert full["decoded"] == "hello</w> there</w>" and len(full["token_ids"]) == 2
    assert bpe.code_column(df.limit(0), bpe.vocabulary_path()).count() == 0
    assert public_tokenizers.path("word_bpe_49k.json") == bpe.vocabulary_path()


def test_every_code_point_in_any_order_with_words_kept():
    """All that some table knows, and every 40th of the others, each beside neighbours that its kind decides on."""
    known = regex.compile(r"[\p{L}\p{N}]")
    cps = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    cps = [c for i, c in enumerate(cps) if unicodedata.category(c) not in ("Cn", "Co") or known.match(c) or i % 40 == 0]
    random.Random(5).shuffle(cps)
    for form in ("{0}'re", "x{0}y", "\0{0}́E9{0} !{0}"):
        texts = [form.format(c) for c in cps]
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            want = [e.ids for e in WORD.encode_batch(part, add_special_tokens=False)]
            assert [list(array("I", ids)) for ids, _ in CODER.code(part)] == want
            assert COUNTER.count(part) == [len(e.ids) for e in BYTE.encode_batch(part, add_special_tokens=False)]


def test_a_kept_word_does_not_decide_for_another_text():
    check(["\U0001df4c", "\x00"])
    check(["\x00\U0001df4c", "՘'re", "re՘"])


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.code_column(df, bpe.vocabulary_path()).count() == 0
    assert token_counts.count_tokens(df, token_counts.vocabulary_path()).count() == 0
