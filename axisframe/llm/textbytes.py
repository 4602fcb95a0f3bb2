"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A text column is walked in slices of about a quarter of a megabyte, so that the temporary
arrays stay small however large an Arrow batch or the whole partition is; one
longer document makes a slice of its own.  Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as the pattern
``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and the bytes of all other characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F | 5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made longer when needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up, self.down


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_WORD_BASE)


@dataclass
class Slice:
    """Some consecutive documents: rows ``first`` to ``first + len - 1`` of a batch."""

    first: int
    data: np.ndarray  # the bytes of all texts, one after the other
    bounds: np.ndarray  # where each text begins in data, and the end of the last
    starts: np.ndarray = field(default=None)  # of words
    ends: np.ndarray = field(default=None)
    of: np.ndarray = field(default=None)  # bounds as numbers of words

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def find_words(self, letters: bool = False) -> Slice:
        """Finds the words; with ``letters``, runs of LETTERS instead."""
        inside = LETTERS[self.data] if letters else ~_SPACE[self.data]
        n = len(inside)
        cut = np.zeros(n + 1, bool)
        cut[self.bounds] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | cut[:n]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.of = np.searchsorted(self.starts, self.bounds)
        return self

    def word_hashes(self, lower: bool = False, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (its first ``most`` ones), with A-Z lower-cased if asked for."""
        data = LOWER[self.data] if lower else self.data
        up, down = _byte_powers.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return mix((total[ends] - total[self.starts]) * down[self.starts])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.of))


class WordRuns:
    """Hashes of runs of words, whatever their length, from one prefix sum."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = _word_powers.upto(len(words) + 1)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=self.total[1:])

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.down[start] + np.asarray(length).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and offsets, without a copy; a null is as an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    data, offs = texts(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        end = min(end, n)
        yield Slice(at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at])
        at = end
