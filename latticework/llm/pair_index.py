"""Byte-pair merging over a pair occurrence index.

All distinct words of a batch are laid out in one chain of symbols.  An index
maps every mergeable pair (named by its rank) to its positions in the whole
batch; active ranks are taken in ascending order from a heap, every listed
position is merged from left to right, and the lists of the two neighbouring
pairs that each merge creates are updated.  Words do not touch, so the order
of merges inside one word is that of ordinary byte-pair encoding.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

#: Ranks below this have long position lists and are merged as arrays; the rest one position at a time.
ARRAY_RANKS = 6000
#: Words that share one index: bounds its memory.
TOGETHER = 40_000
#: Batches of fewer symbols skip the array phase.
ARRAY_SYMBOLS = 20_000


def byte_alphabet() -> list[str]:
    """Printable stand-in for each byte value, as byte-level vocabularies write them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class PairIndex:
    """Merge table of one vocabulary, and the batch encoder over it."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str = ""):
        self.word_end = word_end
        self.tokens = {i: t for t, i in vocab.items()}
        alphabet = byte_alphabet()
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + word_end] for c in alphabet]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, int]] = []
        for pair in merges:
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self.rank[a, b] = len(self.made)
            self.made.append((a, b, vocab[left + right]))
        keys = np.array([(a << 20) | b for a, b, _ in self.made], np.int64)
        self.key_order = np.argsort(keys)
        self.keys = keys[self.key_order]
        # the lowest rank of a pair that holds a token: a merge that makes the token is
        # safe to apply to all positions at once if no such pair goes before it
        low: dict[int, int] = {}
        for r, (a, b, _) in enumerate(self.made):
            low.setdefault(a, r)
            low.setdefault(b, r)
        self.safe = [low.get(new, len(self.made)) > r for r, (_, _, new) in enumerate(self.made)]
        self.first_of, self.last_of = np.array(self.first, np.int64), np.array(self.last, np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it does not merge."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.key_order[at], -1)

    @staticmethod
    def enlist(where: dict, heap: list[int], ranks: np.ndarray, places: np.ndarray) -> None:
        """Add positions to the lists of their ranks."""
        live = ranks >= 0
        ranks, places = ranks[live], places[live]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else [], np.split(places, cuts), strict=False):
            if r in where:
                where[r].append(part)
            else:
                where[r] = [part]
                heapq.heappush(heap, r)

    def merge_arrays(self, sym: np.ndarray, nxt: np.ndarray, prv: np.ndarray, where: dict, heap: list[int]) -> None:
        """Merge the low ranks, each at all its positions at once."""
        while heap and heap[0] < ARRAY_RANKS and self.safe[heap[0]]:
            r = heapq.heappop(heap)
            a, b, new = self.made[r]
            p = np.concatenate(where.pop(r))
            p.sort()
            p = p[np.concatenate(([True], p[1:] != p[:-1]))]
            p = p[sym[p] == a]
            p = p[sym[nxt[p]] == b]
            if a == b and len(p):  # of a run of equal symbols, every second pair from its left end
                i = np.arange(len(p))
                head = np.concatenate(([True], nxt[p[:-1]] != p[1:]))
                p = p[(i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0]
            if not len(p):
                continue
            q = nxt[p]
            after = nxt[q]
            sym[p], sym[q], nxt[p], prv[after] = new, -2, after, p
            before = prv[p]
            pairs_a = np.concatenate((sym[p], np.where(before >= 0, sym[before], -1)))
            pairs_b = np.concatenate((sym[after], sym[p]))
            self.enlist(where, heap, self.ranks(pairs_a, pairs_b), np.concatenate((p, before)))

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (UTF-8 bytes), ``TOGETHER`` words at a time."""
        return [ids for at in range(0, len(words), TOGETHER) for ids in self.merged(words[at : at + TOGETHER])]

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, all of them merged together."""
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size + 1) - 1  # a mark that no pair crosses stands after each word
        n = int(ends[-1]) + 1
        sym = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym[inside] = self.first_of[raw]
        filled = ends[size > 0] - 1
        sym[filled] = self.last_of[raw[(np.cumsum(size) - 1)[size > 0]]]
        nxt, prv = np.minimum(np.arange(1, n + 1), n - 1), np.arange(-1, n - 1)
        where: dict = {}
        heap: list[int] = []
        self.enlist(where, heap, self.ranks(sym[:-1], sym[1:]), np.arange(n - 1))
        if n >= ARRAY_SYMBOLS:
            self.merge_arrays(sym, nxt, prv, where, heap)
        starts = (ends - size).tolist()
        sym, nxt, prv = sym.tolist(), nxt.tolist(), prv.tolist()
        where = {r: np.concatenate(parts).tolist() for r, parts in where.items()}
        rank, made = self.rank, self.made
        while heap:
            r = heapq.heappop(heap)
            places = where.pop(r, None)
            if places is None:
                continue
            places.sort()
            a, b, new = made[r]
            for i, p in enumerate(places):
                q = nxt[p]
                if sym[p] != a or sym[q] != b:
                    continue
                after, before, lower = nxt[q], prv[p], False
                sym[p], sym[q], nxt[p], prv[after] = new, -2, after, p
                for at, pair in ((p, (new, sym[after])), (before, (sym[before] if before >= 0 else -1, new))):
                    s = rank.get(pair)
                    if s is None:
                        continue
                    if s in where:
                        where[s].append(at)
                    else:
                        where[s] = [at]
                        heapq.heappush(heap, s)
                    lower |= s < r
                if lower and i + 1 < len(places):  # a pair of lower rank goes first
                    if r in where:
                        where[r].extend(places[i + 1 :])
                    else:
                        where[r] = places[i + 1 :]
                        heapq.heappush(heap, r)
                    break
        out = []
        for p in starts:
            ids = []
            while (s := sym[p]) != -1:
                ids.append(s)
                p = nxt[p]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def load(path: str) -> tuple[PairIndex, dict[str, int]]:
    """Merge table and special tokens of a tokenizer file; kept by each worker process."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return PairIndex(model["vocab"], model["merges"], model.get("end_of_word_suffix") or ""), special
