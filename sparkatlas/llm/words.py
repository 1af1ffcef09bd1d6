"""Vectorised tokenising over Arrow strings: words, their places and hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are looked at together; a longer text is a part of its own.
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order. np.unique without counts takes a hash table: ten times as long on millions of hashes."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


_POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse mod 2**64, to the powers 0 to n - 1."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE + 64)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Part:
    """Some whole texts: their bytes, and the words in them.

    first, last: byte places of each word (last is exclusive). doc: its text's number in this part.
    at: for each text, the number of its first word, then the number of all words.
    """

    def __init__(self, row: int, raw: np.ndarray, ends: np.ndarray, keep: np.ndarray | None, lower: bool):
        self.row, self.n = row, len(ends) - 1
        self.raw = LOWER[raw] if lower else raw
        self.ends = ends
        if keep is None:
            return
        word = np.zeros(len(raw) + 1, bool)
        word[:-1] = keep[self.raw]
        start = word.copy()
        start[1:] &= ~word[:-1]
        end = ~word
        end[1:] &= word[:-1]
        end[0] = False
        inner = ends[1:-1]
        cut = inner[(inner > 0) & (inner < len(raw))]
        cut = cut[word[cut] & word[cut - 1]]  # two texts meet inside a run
        start[cut] = end[cut] = True
        self.first, self.last = np.flatnonzero(start), np.flatnonzero(end)
        self.at = np.searchsorted(self.first, ends)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.at))

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        if not len(self.first):
            return np.zeros(0, U)
        up, down = powers(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, U)
        np.cumsum((self.raw.astype(U) + U(1)) * up[:-1], out=total[1:])
        return mix((total[self.last] - total[self.first]) * down[self.first] + (self.last - self.first).astype(U))

    def text(self, k: int) -> bytes:
        return self.raw[self.ends[k] : self.ends[k + 1]].tobytes()


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; one for each place but the last k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out *= U(BASE)
        out += words[j : j + n]
    return mix(out)


def starts_of(part: Part, k: int) -> np.ndarray:
    """Numbers of the words that begin k consecutive words of one text."""
    n = len(part.doc) - k + 1
    return np.flatnonzero(part.doc[:n] == part.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)


def parts(column: pa.Array, keep: np.ndarray | None = SPACE, lower: bool = False, size: int = SLICE) -> Iterator[Part]:
    """The texts of an Arrow string column, some at a time; null is the empty text. keep: a table of word bytes (SPACE: all but these)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    keep = ~SPACE if keep is SPACE else keep
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(ends, ends[row] + size, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield Part(row, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row], keep, lower)
        row = stop


def windows_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """windows(words, k) at the given places only."""
    out = np.zeros(len(at), U)
    for j in range(k):
        out *= U(BASE)
        out += words[at + j]
    return mix(out)
