"""Vectorised word, shingle and window hashes over Arrow string batches.

Texts stay in their Arrow buffer: words are found as byte spans and hashed with prefix sums of a
polynomial modulo 2**64, so that the hash of any window of words costs two look-ups, whatever its
length. A word is a run of bytes other than the ASCII blanks 0x20 and 0x09 to 0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, n, dtype=np.uint64)


_BYTE_VALUES = _random_words(256, 7)
_LOWERED_VALUES = _BYTE_VALUES.copy()
_LOWERED_VALUES[65:91] = _BYTE_VALUES[97:123]
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLES: dict[int, np.ndarray] = {}


def _power_table(n: int, base: int) -> np.ndarray:
    """At least ``n`` powers of ``base``; a table only ever grows."""
    table = _TABLES.get(base)
    if table is None or len(table) < n:
        powers = np.full(1 << max(19, int(n - 1).bit_length()), _U(base))
        powers[0] = 1
        table = _TABLES[base] = np.cumprod(powers, dtype=np.uint64)
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_table(n, _MULTIPLIER), _power_table(n, pow(_MULTIPLIER, -1, 2**64))


class Windows:
    """Hashes of all windows over a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self._down = _powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each window ``[start, end)``; equal sequences have equal hashes."""
        spans = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(spans + (end - start).astype(np.uint64))


class Texts:
    """The words of some texts: per word its hash and byte span, per text its first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lowered: bool):
        self.data, self.offsets = data, offsets
        solid = ~BLANK[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[filled] = solid[filled]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] = solid[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        #: Word ``first[i]`` is the first of text ``i``; ``first[-1]`` is the number of words.
        self.first = np.searchsorted(self.starts, offsets)
        table = _LOWERED_VALUES if lowered else _BYTE_VALUES
        #: Hashes of byte spans.
        self.spans = Windows(table[data])
        self.hashes = self.spans.at(self.starts, self.ends)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and text of each window of ``length`` words."""
        room = np.maximum(self.n_words - length + 1, 0)
        text = np.repeat(np.arange(len(room)), room)
        skipped = np.cumsum(room) - room
        return np.arange(room.sum()) - skipped[text] + self.first[text], text


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Begin and end of consecutive rows whose texts have about ``size`` bytes."""
    _, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def texts(column: pa.Array, lowered: bool) -> Texts:
    return Texts(*string_buffers(column), lowered)


def chunks(column: pa.Array, lowered: bool, size: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """Number of the first text and words of consecutive texts of about ``size`` bytes."""
    for row, end in slices(column, size):
        yield row, texts(column.slice(row, end - row), lowered)


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as the signed longs Spark has."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
