"""Vectorised words over the UTF-8 bytes of an Arrow batch.

Words are runs of bytes outside a set of ASCII separators, so they never cut a
multi-byte character.  A word's hash is a polynomial over randomised byte values
modulo 2**64, taken from running sums, then mixed; its cost per byte does not depend
on the length of words or texts, and running sums are carried over slices, so a very
long text needs memory for its words and not eight bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = int(_rng.integers(2**40, 2**60)) * 8 + 3
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SLICE = 1 << 18
SHINGLE_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

SPACES = b" \t\n\x0b\x0c\r"


def separator_table(separators: bytes) -> np.ndarray:
    """A 256-entry table: True for the bytes that part words."""
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


WHITE = separator_table(SPACES)
#: all ASCII but digits and letters: what [^\x00-\x2F\x3A-\x60\x7B-\x7F] excludes, after lower-casing
NOT_ALNUM = separator_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place): every input bit reaches every output bit."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _SLICE + 1)
_INV = _powers(_BASE_INVERSE, _SLICE + 1)


def _inverse_power(at: np.ndarray) -> np.ndarray:
    """BASE ** -at, with one table for the low and one for the high part of ``at``."""
    high = _powers(int(pow(_BASE_INVERSE, _SLICE, 2**64)), int(at[-1] // _SLICE) + 1) if len(at) else _INV
    return _INV[at % _SLICE] * high[at // _SLICE]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of all texts; no word crosses a text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~separators[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:]
    end = word
    end[:-1] &= ~word[1:] | first[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word given by ``word_bounds``."""
    at_start = np.empty(len(starts), np.uint64)
    at_end = np.empty(len(ends), np.uint64)
    carry, scale, i, j = U64(0), 1, 0, 0
    for lo in range(0, len(data), _SLICE):
        part = data[lo : lo + _SLICE]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUE[part] * _POW[: len(part)], out=sums[1:])
        sums *= U64(scale)
        sums += carry
        hi = lo + len(part)
        k, m = np.searchsorted(starts, hi), np.searchsorted(ends, hi, side="right")
        at_start[i:k] = sums[starts[i:k] - lo]
        at_end[j:m] = sums[ends[j:m] - lo]
        i, j, carry, scale = k, m, sums[-1], scale * int(_POW[_SLICE]) % 2**64
    return mix((at_end - at_start) * _inverse_power(starts))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of ``k`` words; of all words as one run if there are fewer but not none."""
    k = min(k, len(words))
    if k == 0:
        return words[:0]
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += words[i : i + n] * SHINGLE_FACTORS[i]
    return mix(out)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (from 0) and validity of a string or binary column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    valid = ~column.is_null().to_numpy(zero_copy_only=False)
    if not valid.all():
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, ends, values = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0], valid


def slices(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def hashed_words(column: pa.Array, separators: np.ndarray, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word offsets by row, word hashes) for each slice of the rows of ``column``."""
    data, offsets, _ = texts_of(column)
    for i, j in slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        part = LOWER[part] if lower else part
        starts, ends = word_bounds(part, own, separators)
        yield i, np.searchsorted(starts, own), word_hashes(part, starts, ends)
