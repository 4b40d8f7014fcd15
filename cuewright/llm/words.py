"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage
return. All six are single UTF-8 bytes, so words can be cut out of the raw bytes of a whole batch at once.

A word's hash is a sum of random numbers, one for each place and byte, and a run of words goes by its words mixed with
their places, or pairwise: no two texts are known to collide. Seeds 0 and 1 draw on tables of their own, so that two of them are 128
bits. feature_hashes() and span_hashes() are cheaper, a polynomial modulo 2**64, which texts of a certain form
collide under; they only serve features and candidates, never to tell that texts are equal.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b" \t\n\v\f\r"
_IS_SEPARATOR = np.isin(np.arange(256), list(SEPARATORS))
#: Bytes of text, and rows, that are handled at once; a longer text is handled alone.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and len+1 offsets; a null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, most: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about that many bytes, and at most so many rows."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + most, rows)
        yield first, last
        first = last


def chunked(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, most: int = CHUNK_ROWS):
    """(first row, last row, bytes, offsets) for each chunk of a batch."""
    data, offsets = text_bytes(batch.column(column))
    for first, last in row_chunks(offsets, limit, most):
        at = offsets[first : last + 1]
        yield first, last, data[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each row the number of its first word (len+1 of them). `apart` tells which bytes end words."""
    n = len(data)
    inside = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_RNG = np.random.default_rng(1000)
_BYTE_VALUES = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = int(_RNG.integers(1 << 62)) * 2 + 1

#: Powers of _ODD and of its inverse, for all seeds.
_powers: list[np.ndarray] = []


def _power_table(n: int) -> list[np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers
    size, grown = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 3)), []
    for factor in (_ODD, pow(_ODD, -1, 1 << 64)):
        row = np.full(size, factor, np.uint64)
        row[0] = 1
        grown.append(np.multiply.accumulate(row))
    if size <= 4 * CHUNK_BYTES:
        _powers[:] = grown
    return grown


def release() -> None:
    """Gives what this module keeps, and memory that was freed before, back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns freed memory, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal spans wherever they lie."""
    n = len(values)
    up, down = _power_table(n + 1)
    if seed:
        values = mix(values + np.uint64(seed * 0x9FB21C651E98DF25 & (2**64 - 1)))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def feature_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE_VALUES[data], start, end)


#: Random numbers for each of PLACES places and each byte; later places mix them with their number.
PLACES = 16
_TABLES = np.random.default_rng(1001).integers(1 << 63, size=(2, PLACES * 256), dtype=np.uint64) * np.uint64(2) + np.random.default_rng(1002).integers(2, size=(2, PLACES * 256), dtype=np.uint64)
_STEP = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def _places(n: int, start: np.ndarray) -> np.ndarray:
    """How far each item is from the last start before it."""
    begins = np.zeros(n, np.int64)
    begins[start[start < n]] = start[start < n]
    return np.arange(n) - np.maximum.accumulate(begins)


def _summed(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mix(total[end] - total[start] + (end - start).astype(np.uint64) * _STEP[seed])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words, which don't overlap, from the seed's table."""
    place = _places(len(data), start)
    values = _TABLES[seed][(place % PLACES << 8) | data]
    far = np.flatnonzero(place >= PLACES)
    values[far] = mix(values[far] + (place[far] // PLACES).astype(np.uint64) * _STEP[seed])
    return _summed(values, start, end, seed)


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of runs of words, which don't overlap, from the words' hashes."""
    return _summed(mix(hashes + _places(len(hashes), start).astype(np.uint64) * _STEP[seed]), start, end, seed)


def gram_hashes(hashes: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the runs of `width` words that begin at the places `at`: words meet in pairs, pairs of pairs and so on."""
    joined = lambda a, b: mix(a * _STEP[seed] + b)
    n, size, done, out = len(hashes) - width + 1, 1, 0, None
    if n <= 0:
        return np.zeros(0, np.uint64)
    while size <= width:
        if width & size:
            part = hashes[done : done + n]
            out, done = part if out is None else joined(out, part), done + size
        hashes, size = joined(hashes[:-size], hashes[size:]) if 2 * size <= width else hashes, 2 * size
    return mix(out[at] + np.array([width], np.uint64) * _STEP[seed])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, on bytes; other letters stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def gram_starts(first_word: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a run of `width` words begins that ends in the same row."""
    n = int(first_word[-1])
    row_end = np.repeat(first_word[1:], np.diff(first_word))
    return np.flatnonzero(np.arange(n) + width <= row_end)


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
