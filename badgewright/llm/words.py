"""Words of a batch of texts as numpy arrays: where they stand, and 64-bit hashes of them.

Nothing here makes a Python object per word. Hashes of bytes and of runs of words are
polynomials modulo 2^64 over random values, mixed at the end; memory is bounded by blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
# Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_values: bool = False) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair; the starts ascend."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(starts, low + BLOCK)))
        here = values[low : int(ends[first:last].max(initial=low))]
        here = _BYTE[here] if byte_values else here
        power, inverse = _powers(len(here) + 1)
        sums = np.zeros(len(here) + 1, dtype=np.uint64)
        np.cumsum(here * power[: len(here)], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


@dataclass
class Words:
    """``rows``: byte offsets of the texts; ``first``: number of each text's first word (both one longer)."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends, byte_values=True)

    def text(self, word: int, end: int) -> bytes:
        """The bytes from one word to before another, with what stands between."""
        return self.data[self.starts[word] : self.ends[end - 1]].tobytes() if end > word else b""


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and their offsets (one more than texts). Nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[rows[0] : rows[-1]], rows - rows[0]


def pieces(data: np.ndarray, rows: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators, no run going on into another text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = separator[data]
    before, after = np.empty_like(apart), np.empty_like(apart)
    before[1:], after[:-1] = apart[:-1], apart[1:]
    before[0] = after[-1] = True
    before[rows[:-1][rows[:-1] < len(data)]] = True
    after[rows[1:][rows[1:] > 0] - 1] = True
    return np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1


def split_words(texts: pa.Array, separator: np.ndarray = SPACES) -> Words:
    data, rows = text_bytes(texts)
    starts, ends = pieces(data, rows, separator)
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows))


def windows(words: Words, size: int) -> np.ndarray:
    """Numbers of the words at which a window of ``size`` words of one text starts."""
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))
    return np.flatnonzero(left >= size)
