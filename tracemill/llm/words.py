"""Words of many texts at once, as hashes in numpy: no Python object per word."""

from __future__ import annotations

import numpy as np
import xxhash

from .shingles import mixed

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Longer words are hashed one by one.
_LONG = 1024
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


class Words:
    """Words (runs of anything but space and 0x09-0x0D) of a list of byte texts, in order.

    ``hashes``: one 64-bit number per word, equal for equal words (A-Z as a-z if ``fold``): its bytes go in by eights, each mixed into what came
    before; words of over 1,024 bytes by xxh3. ``checks``: a second one with another seed, if asked for. ``text``: index of the text; ``line``:
    number of the line within it.
    """

    def __init__(self, bodies: list[bytes | None], fold: bool = True, checks: bool = False) -> None:
        joined = b"\n".join([b or b"" for b in bodies]) + b"\n" + bytes(8)
        if fold:
            joined = joined.lower()  # bytes.lower() changes A-Z alone
        self.joined = joined
        buffer = np.frombuffer(joined, dtype=np.uint8)[:-8]
        space = _SPACE[buffer]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.array([len(b or b"") + 1 for b in bodies], dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        feeds = np.flatnonzero(buffer == 10)
        # how many texts, and line feeds, begin before each word
        before = lambda places: np.cumsum(np.bincount(np.searchsorted(self.starts, places), minlength=len(self.starts) + 1))[: len(self.starts)]
        self.text = before(first) - 1
        self.line = before(feeds) - np.searchsorted(feeds, first)[self.text]
        sizes = self.ends - self.starts
        eights = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
        self.hashes = self._hashed(eights, sizes, 0)
        self.checks = self._hashed(eights, sizes, 1) if checks else None

    def _hashed(self, eights: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
        seed = _SEEDS[which]
        out = mixed((eights[self.starts] & _MASKS[np.minimum(sizes, 8)]) + seed * (sizes.astype(np.uint64) + np.uint64(1)))
        at, left = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
        while len(at):
            out[at] = mixed(out[at] * seed + mixed(eights[self.starts[at] + left] & _MASKS[np.minimum(sizes[at] - left, 8)]))
            left += 8
            at = at[sizes[at] > left]
        for k in np.flatnonzero(sizes > _LONG):
            out[k] = xxhash.xxh3_64_intdigest(self.joined[self.starts[k] : self.ends[k]], seed=which)
        return out


class Units:
    """Words of texts, each with what joins it to the word before: 0 nothing (start of the text), 1 a space, 2 a line feed.

    ``regular`` tells for each text whether it is just that: words, with one space or line feed between any two. Only then its units say all of it.
    ``keys`` and ``checks``: two 64-bit hashes of word and kind.
    """

    def __init__(self, bodies: list[bytes | None]) -> None:
        words = Words(bodies, fold=False, checks=True)
        self.joined = words.joined
        buffer = np.frombuffer(self.joined, dtype=np.uint8)
        n = np.array([len(b or b"") for b in bodies], dtype=np.int64)
        first = np.cumsum(n + 1) - n - 1
        text, starts, ends = words.text, words.starts, words.ends
        opens = np.ones(len(text), dtype=bool)
        opens[1:] = text[1:] != text[:-1]
        closes = np.roll(opens, -1)
        before = np.empty_like(starts)
        before[1:] = ends[:-1]
        before = np.where(opens, first[text], before)
        good = np.where(opens, starts == before, (starts - before == 1) & np.isin(buffer[before], (32, 10)))
        good &= ~closes | (ends == (first + n)[text])
        self.kind = np.where(opens, 0, np.where(buffer[before] == 10, 2, 1))
        counts = np.bincount(text, minlength=len(bodies))
        self.regular = (counts > 0) & (np.bincount(text[~good], minlength=len(bodies)) == 0)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.starts, self.ends = starts, ends
        self.keys = mixed(words.hashes + self.kind.astype(np.uint64))
        self.checks = mixed(words.checks + self.kind.astype(np.uint64))

    def without(self, odd: np.ndarray) -> np.ndarray:
        """``regular`` but for the texts that hold one of the odd units."""
        out = self.regular.copy()
        if odd.any():
            out[np.unique(np.searchsorted(self.bounds, np.flatnonzero(odd), side="right") - 1)] = False
        return out


class KnownUnits:
    """What was found for units, by key: ids of each in one flat array, and columns of numbers beside them.

    A unit with the key but not the check of a known one is told apart, for its text to be taken as a whole.
    At ``limit`` units those used in one call only are forgotten, or all, if that leaves half of the limit or more.
    """

    def __init__(self, dtype: str, columns: int, limit: int) -> None:
        self.dtype, self.columns, self.limit = np.dtype(dtype), columns, limit
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = np.empty(0, dtype=self.dtype)
        self.first, self.size, self.uses = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.checks = np.empty(0, dtype=np.uint64)
        self.numbers = np.empty((self.columns, 0))

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.uses > 1)
        if 2 * len(keep) >= self.limit:
            self.forget()
            return
        moved = np.full(len(self.uses), -1, dtype=np.int64)
        moved[keep] = np.arange(len(keep))
        where = moved.tolist()
        self.place = {k: where[p] for k, p in self.place.items() if where[p] >= 0}
        self.flat = self.flat[gathered(self.first[keep], self.size[keep])]
        self.size = self.size[keep]
        self.first = np.cumsum(self.size) - self.size
        self.uses, self.numbers, self.checks = np.ones(len(keep), dtype=np.int64), self.numbers[:, keep], self.checks[keep]

    def places(self, units: Units, find) -> tuple[np.ndarray, np.ndarray]:
        """The place of each unit, and whether it is odd: another unit has its key and place.

        ``find(indices of units not known)`` gives their ids (flat), sizes and numbers.
        """
        if len(self.place) > self.limit:
            self._shrink()
        keys, index, inverse = np.unique(units.keys, return_index=True, return_inverse=True)
        get = self.place.get
        found = np.array([get(k, -1) for k in keys.tolist()], dtype=np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            flat, size, numbers = find(index[new])
            found[new] = len(self.size) + np.arange(len(new))
            self.place.update(zip(keys[new].tolist(), found[new].tolist(), strict=True))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
            self.size = np.concatenate([self.size, size])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])
            self.numbers = np.concatenate([self.numbers, numbers], axis=1)
            self.checks = np.concatenate([self.checks, units.checks[index[new]]])
        self.uses[found] += 1
        places = found[inverse]
        return places, self.checks[places] != units.checks

    def ids(self, places: np.ndarray) -> np.ndarray:
        """Ids of the units at these places, one after another."""
        return self.flat[gathered(self.first[places], self.size[places])]


def gathered(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first, first + 1, ... of runs of these sizes, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)
