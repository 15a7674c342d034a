"""Locally consistent parsing: hierarchical phrase names by deterministic coin tossing.

On each level, runs of one symbol become one; then every symbol gets a label
from the lowest bit in which it differs from its left neighbour, three times
over, until the labels are small; local maxima of the labels begin phrases, and
a phrase's name is the hash of its symbols.  Where a phrase begins depends on a
few neighbours only, so equal substrings are cut alike, whatever stands before
them, but for a margin at their ends.
"""

from __future__ import annotations

import base64

import numpy as np

from latticework.llm.bags import mixed

U = np.uint64
#: Smallest name hashes that a fingerprint keeps: of the first level, whose phrases are short and common, and of all above.
FIRST, HIGHER = 16, 96

Sketch = tuple[np.ndarray, np.ndarray]


def tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """New label of each symbol: twice the lowest bit that differs from the left neighbour, plus the symbol's bit."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    v = x ^ left
    low = np.bitwise_count((v & (~v + x.dtype.type(1))) - x.dtype.type(1))
    return (2 * low + ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def level(x: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and texts of the phrases of one level, from those of the level below."""
    n = len(x)
    head = np.ones(n, bool)  # of runs
    head[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(head)
    if len(at) < n:
        length = np.diff(np.append(at, n))
        x = np.where(length > 1, mixed(x[at] ^ (length.astype(U) * U(0xD6E8FEB86659FD93))), x[at])
        text = text[at]
        n = len(x)
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    begins = np.flatnonzero(first)
    label = tossed(tossed(tossed(x, begins), begins), begins).astype(np.int8)
    before, after = np.full(n, -1, np.int8), np.full(n, -1, np.int8)
    before[1:], after[:-1] = label[:-1], label[1:]
    before[begins] = 127  # a text's first symbol begins a phrase, its second does not
    start = (label > before) & (label >= after)
    start[begins] = True
    second = begins[:-1] + 1 if len(begins) and begins[-1] == n - 1 else begins + 1
    start[second] = first[second]
    at = np.flatnonzero(start)
    place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    names = mixed(np.add.reduceat(mixed(x + place.astype(U) * U(0x9E3779B97F4A7C15)), at))
    return names, text[at]


def least(owners: list[np.ndarray], names: list[np.ndarray], n: int, k: int) -> list[np.ndarray]:
    """For each of ``n`` texts its ``k`` smallest names, sorted."""
    if not names:
        return [np.zeros(0, np.uint32) for _ in range(n)]
    key = (np.concatenate(owners).astype(U) << U(32)) | np.concatenate(names)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    owner = (key >> U(32)).astype(np.int64)
    start = np.searchsorted(owner, np.arange(n + 1))
    small = (key & U(0xFFFFFFFF)).astype(np.uint32)
    return [small[a : min(b, a + k)] for a, b in zip(start[:-1], start[1:], strict=True)]


def sketches(texts: list[str]) -> list[Sketch]:
    """For each text the smallest hashes of its phrase names, those of the first level and those of all above, whatever its length.

    A text goes up until it is one phrase; an empty one has no names.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(U) + U(1)
    text = np.repeat(np.arange(len(texts)), sizes)
    names, owners, depth = [], [], 0
    while len(x):
        x, text = level(x, text)
        depth += 1
        names.append(mixed(x + U(depth)) >> U(32))
        owners.append(text)
        more = (np.bincount(text, minlength=len(texts)) > 1)[text]
        x, text = x[more], text[more]
    return list(zip(least(owners[:1], names[:1], len(texts), FIRST), least(owners[1:], names[1:], len(texts), HIGHER), strict=True))


def written(sketch: Sketch) -> str:
    """Base64 of the number of first-level names and all names; empty for an empty text."""
    first, higher = sketch
    if not len(first):
        return ""
    return base64.b64encode(np.concatenate(([len(first)], first, higher)).astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> Sketch:
    found = np.frombuffer(base64.b64decode(fingerprint), "<u4")
    return (found[1 : 1 + found[0]], found[1 + found[0] :]) if len(found) else (found, found)


def likeness(a: Sketch, b: Sketch) -> float:
    """Share of common names among the smallest of both, the first level and those above counted together; two empty texts are alike."""
    hits = seen = 0
    for x, y, k in zip(map(set, (c.tolist() for c in a)), map(set, (c.tolist() for c in b)), (FIRST, HIGHER), strict=True):
        common, smallest = x & y, sorted(x | y)[:k]
        hits += sum(v in common for v in smallest)
        seen += len(smallest)
    return hits / seen if seen else 1.0
