"""Similarity of texts by longest matching blocks (Ratcliff and Obershelp), each block found with a suffix automaton.

Ratio: twice the matched characters over those of both texts. The longest block of both texts (the earliest in the first, then in the second, among ties) is matched,
then the texts before and behind it likewise. In a second text of 200 characters and more, characters that make up over a hundredth of it don't begin or join blocks;
they only lengthen a block at its ends. An automaton of the second text is walked through with the first, so a block costs both lengths, not their product.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: From which length on characters can be too frequent, and the share that makes them so.
POPULAR_FROM, POPULAR_SHARE = 200, 100


class _Automaton:
    """All substrings of a sequence of symbols; ``first`` is where the earliest occurrence of a state's strings ends. None separates: nothing runs across."""

    def __init__(self, symbols: list[str | None]) -> None:
        self.link, self.size, self.first, self.step = [-1], [0], [-1], [{}]
        link, size, first, step = self.link, self.size, self.first, self.step
        last = 0
        for at, c in enumerate(symbols):
            if c is None:
                last = 0
                continue
            known = step[last].get(c)
            if known is not None:  # only after a separator: the string so far has been seen
                last = known if size[known] == size[last] + 1 else self._cloned(last, c, known)
                continue
            new = len(link)
            link.append(0)
            size.append(size[last] + 1)
            first.append(at)
            step.append({})
            state = last
            while state >= 0 and c not in step[state]:
                step[state][c] = new
                state = link[state]
            if state >= 0:
                after = step[state][c]
                link[new] = after if size[after] == size[state] + 1 else self._cloned(state, c, after)
            last = new

    def _cloned(self, state: int, c: str, after: int) -> int:
        """A state for the shorter strings of ``after`` alone."""
        new = len(self.link)
        self.link.append(self.link[after])
        self.size.append(self.size[state] + 1)
        self.first.append(self.first[after])
        self.step.append(dict(self.step[after]))
        self.link[after] = new
        while state >= 0 and self.step[state].get(c) == after:
            self.step[state][c] = new
            state = self.link[state]
        return new

    def longest(self, text: str, start: int, end: int) -> tuple[int, int, int]:
        """(place in text, place in the sequence, size) of the longest common block."""
        link, size, step = self.link, self.size, self.step
        best, best_end, best_state, state, length = 0, 0, 0, 0, 0
        for at in range(start, end):
            c = text[at]
            while state and c not in step[state]:
                state = link[state]
                length = size[state]
            after = step[state].get(c)
            if after is None:
                continue
            state, length = after, length + 1
            if length > best:
                best, best_end, best_state = length, at + 1, state
        return best_end - best, self.first[best_state] + 1 - best, best


def matched(a: str, b: str) -> int:
    """Characters in matching blocks."""
    popular: set[str] = set()
    if len(b) >= POPULAR_FROM:
        most = len(b) // POPULAR_SHARE + 1
        popular = {c for c, n in Counter(b).items() if n > most}
    symbols: list[str | None] = [None if c in popular else c for c in b]
    total, agenda = 0, [(0, len(a), 0, len(b))]
    while agenda:
        a0, a1, b0, b1 = agenda.pop()
        if a[a0:a1] == b[b0:b1]:
            total += a1 - a0
            continue
        i, j, n = _Automaton(symbols[b0:b1]).longest(a, a0, a1)
        j += b0
        if not n:
            i, j = a0, b0
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < a1 and j + n < b1 and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            agenda += [w for w in ((a0, i, b0, j), (i + n, a1, j + n, b1)) if w[0] < w[1] and w[2] < w[3]]
    return total


def ratio(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    both = len(a) + len(b)
    return 2.0 * matched(a, b) / both if both else 1.0


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two columns of texts, NULL as the empty text; a pair that comes again in a batch is worked out once."""
    pairs = list(zip(a.where(a.notna(), ""), b.where(b.notna(), ""), strict=True))
    known = {p: ratio(*p) for p in set(pairs)}
    return pd.Series([known[p] for p in pairs], dtype="float64")
