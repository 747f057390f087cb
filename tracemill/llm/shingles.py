"""Word shingles of whole texts as 64-bit numbers, and fast similarity sketches of them."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class WordNumbers(dict):
    """Word -> 64-bit hash; forgets all at ``limit`` words, so that a task's memory is bounded."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def shingle_set(text: bytes | None, width: int, numbers: WordNumbers) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; A-Z count as a-z; fewer words are one shingle."""
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(numbers.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        out = mixed(out * _STEP + h[k : k + n])
    return np.unique(out)


def set_key(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers: equal for equal sets."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch: ``size`` coordinates, each filled for every set that is not empty.

    Round i hashes each element to a bin and a value; a bin keeps the smallest value of the first round that reaches it.
    Rounds 0 to size-1 pick bins at random; round size+j sends every element to bin j, so that none stays empty.
    Expected work is that of about size * log(size) hashed elements, or one round for a large set. Two sets agree in a
    coordinate with the probability of their Jaccard similarity, with bounds on the deviation like those of
    independent coordinates.
    """
    filled = np.zeros(size, dtype=bool)
    out = np.zeros(size, dtype=np.uint64)
    at_once = max(1, 2 * size // max(1, len(elements)))
    first = 0
    while first < size and not filled.all():
        rounds = np.arange(first, min(size, first + at_once), dtype=np.uint64)
        h = mixed(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _STEP)
        bins = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        value = mixed(h)
        keys = (np.arange(len(rounds), dtype=np.int64)[:, None] * size + bins.astype(np.int64)).ravel()
        low = np.full(len(rounds) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(low, keys, value.ravel())
        reached = np.zeros(len(rounds) * size, dtype=bool)
        reached[keys] = True
        for k in range(len(rounds)):
            new = reached[k * size : (k + 1) * size] & ~filled
            out[new] = low[k * size : (k + 1) * size][new]
            filled |= new
        first += at_once
    for j in np.flatnonzero(~filled):
        out[j] = mixed(mixed(elements + np.array([size + j + 1], dtype=np.uint64) * _STEP)).min()
    return out


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of ``rows`` coordinates."""
    table = coordinates.reshape(-1, rows)
    out = np.arange(1, len(table) + 1, dtype=np.uint64) * _STEP
    for k in range(rows):
        out = mixed(out + table[:, k] * _MIX_A)
    return out.view(np.int64)
