"""Bags of five-word shingles and their BagMinHash signatures, vectorised over many texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

WIDTH = 5
#: Words of the texts that are hashed together; a longer text is hashed alone.
BATCH_WORDS = 300_000
BATCH_TEXTS = 2048
#: Words whose hashes a worker keeps; at this many it starts anew, results are the same.
KEPT_WORDS = 150_000

U = np.uint64
STEPS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hash of each word, computed at first sight."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h


def batches(texts: list[str]) -> Iterator[tuple[int, list[list[str]]]]:
    """(first text, word lists) of groups of texts that are hashed together."""
    first, group, words = 0, [], 0
    for i, t in enumerate(texts):
        ws = t.split()
        if group and (words + len(ws) > BATCH_WORDS or len(group) >= BATCH_TEXTS):
            yield first, group
            first, group, words = i, [], 0
        group.append(ws)
        words += len(ws)
    if group:
        yield first, group


def bag(lists: list[list[str]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), by text and hash, of the distinct shingles of each text.

    A text of one to four words has one shingle, all of it; a text without words has none.
    """
    sizes = np.array([len(ws) for ws in lists], np.int64)
    padded = np.where(sizes > 0, np.maximum(sizes, WIDTH), 0)
    total = int(padded.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(total, U)
    starts = np.cumsum(padded) - padded
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    h[at] = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), U, int(sizes.sum()))
    text = np.repeat(np.arange(len(lists)), padded)
    room = np.repeat(starts + padded, padded) - np.arange(total) >= WIDTH
    n = total - WIDTH + 1
    s = np.zeros(n, U)
    for j in range(WIDTH):
        s += (h[j : j + n] ^ (h[j : j + n] >> U(32))) * STEPS[j]
    s, text = mixed(s[room[:n]]), text[:n][room[:n]]
    ends = np.flatnonzero(np.concatenate((text[1:] != text[:-1], [True]))) + 1
    at = 0
    for end in ends.tolist():
        s[at:end].sort()
        at = end
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    return text[first], s[first], np.diff(np.concatenate((first, [len(s)])))


def bag_min_hash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures of shape (n_texts, m); two bags agree in a component with probability their weighted Jaccard.

    The weight axis is cut into the dyadic intervals [0, 1), [1, 2), [2, 4), ...
    Each (element, interval) has its own Poisson process whose rate is the
    interval's width; a point has a time, a component and a level within the
    interval, all hashed from element, interval and number, so it is the same
    in every bag.  A bag sees the points with a level below its weight.  The
    signature keeps each component's earliest time, and a process is followed
    only up to the time by which every component of its bag has a point.
    Bags without elements have infinite times.
    """
    out = np.full((n_texts, m), np.inf)
    if not len(text):
        return out
    total = np.bincount(text, weight, n_texts)
    end = np.where(total > 0, m / np.maximum(total, 1) * (np.log(m) + 5.0), 0.0)
    depth = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # intervals that begin below the weight
    row = np.repeat(np.arange(len(text)), depth)
    level = np.arange(len(row)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    rate = np.where(level == 0, 1.0, low)
    name = mixed(element[row] + level.astype(U) * U(0x9E3779B97F4A7C15))
    todo = np.arange(len(row))
    while len(todo):
        t, live, i = np.zeros(len(todo)), todo, 0
        flat = out.reshape(-1)
        while len(live):
            i += 1
            x = mixed(name[live] + U((i * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
            u = ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
            t = t - np.log(u) / rate[live]
            near = t < end[text[row[live]]]
            live, t, x = live[near], t[near], x[near]
            if not len(live):
                break
            y = mixed(x ^ STEPS[1])
            k = ((y & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
            at = low[live] + np.floor((y >> U(32)).astype(np.float64) * 2.0**-32 * rate[live])
            seen = at < weight[row[live]]
            np.minimum.at(flat, text[row[live[seen]]] * m + k[seen], t[seen])
        short = np.isinf(out).any(1) & (total > 0)
        end = np.where(short, end * 2, 0.0)
        todo = np.flatnonzero(short[text[row]])
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` components; bands never share hashes but by chance."""
    n, m = signature.shape
    bits = signature.view(U).reshape(n, m // rows, rows)
    h = np.broadcast_to(mixed(np.arange(1, m // rows + 1, dtype=U) * STEPS[2]), (n, m // rows)).copy()
    for j in range(rows):
        h = mixed(h ^ (bits[:, :, j] * STEPS[j % WIDTH]))
    return h.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(intersection, union) of two bags given as sorted hashes and counts."""
    (x, n), (y, k) = a, b
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    hit = y[at] == x if len(y) else np.zeros(len(x), bool)
    inter = int(np.minimum(n[hit], k[at[hit]]).sum()) if len(y) else 0
    return inter, int(n.sum() + k.sum()) - inter
