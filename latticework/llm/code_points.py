"""Code points on which Python's Unicode tables and the tokenizers library's may differ.

Those are the ones that Python's tables leave unassigned, and three marks.  The
``regex`` module and the library know some of them, each by tables of its own
age; so the library is asked once for the kind of each that occurs, and a text
is split with a stand-in of that kind.  Tests compare every code point with
the library.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Marks that the library's normaliser puts in another order.
MARKS = (0x1DF6, 0x1E4EC, 0x1E4ED)
#: A letter, a number and a mark that no pattern names and every table knows.
LETTER, NUMBER, OTHER = 0x3042, 0x0663, 0x203B


@lru_cache(maxsize=1)
def table() -> np.ndarray:
    """Whether each code point is odd."""
    found = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    found[list(MARKS)] = True
    return found


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def odd(texts: list[str]) -> frozenset[int]:
    """Places of the texts that hold odd code points."""
    joined = "".join(texts)
    if joined.isascii():
        return frozenset()
    hit = np.flatnonzero(table()[codes(joined)])
    if not len(hit):
        return frozenset()
    return frozenset(np.searchsorted(np.cumsum([len(t) for t in texts]), hit, side="right").tolist())


class Library:
    """What a tokenizer file's own normaliser and splitter say of odd code points."""

    def __init__(self, path: str):
        self.path = path
        self.kinds: dict[int, int] = {}

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def normalised(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text)

    def kind(self, code: int) -> int:
        """The stand-in of an odd code point; none of them is white space."""
        if code not in self.kinds:
            joins = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c + chr(code))[0][1] == (0, 2)
            self.kinds[code] = LETTER if joins("a") else OTHER if joins("!") else NUMBER
        return self.kinds[code]

    def split(self, pattern, text: str) -> list[str]:
        """The pattern's finds in a text with odd code points."""
        changed = codes(text).copy()
        at = np.flatnonzero(table()[changed])
        changed[at] = [self.kind(c) for c in changed[at].tolist()]
        return [text[m.start() : m.end()] for m in pattern.finditer(changed.tobytes().decode("utf-32-le"))]
