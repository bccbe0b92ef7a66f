"""Texts as NumPy arrays inside tasks: batches, words, 64-bit hashes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

MULT = 0x9E3779B97F4A7C15
SEGMENT = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(first row, end row, bytes, offsets)`` of a string column, of ``most`` bytes or a single longer text.

    Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    # The bytes are looked at where they lie, not copied.
    _, places, data = column.buffers()
    kind = np.int32 if pa.types.is_string(column.type) else np.int64
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Separators; bytes in lower case (A-Z only); a random 64-bit value per byte, as it is and in lower case."""
    separator = np.zeros(256, bool)
    separator[[32, *range(9, 14)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULT)) | np.uint64(1)
    return separator, lower, value, value[lower]


def powers(n: int, base: int) -> np.ndarray:
    """1, ``base``, its square and so on, modulo 2 ** 64; up to ``SEGMENT`` of them are kept."""
    if n <= SEGMENT:
        return _powers(SEGMENT, base)[: max(n, 1)]
    return _powers.__wrapped__(n, base)


@cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    out.flags.writeable = False
    return out


def places(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a slice: row, first byte, end byte. ``separator`` (a flag per byte value) makes words of other runs."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    # Byte i + 1 of ``edge`` is 1 where a word begins or ends before byte i: at a separator, or where a row begins.
    inside = np.zeros(n + 2, bool)
    np.logical_not((tables()[0] if separator is None else separator)[data], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    joined = np.unique(inner[inside[inner] & inside[inner + 1]])
    cuts = np.flatnonzero(edge)
    if len(joined):
        # A word of one row that touches the next row's ends and begins there.
        cuts = np.sort(np.r_[cuts, joined, joined])
    begin, end = cuts[::2], cuts[1::2]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(begin, offsets)))
    return row, begin, end


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, separator: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a slice: hash, row, first byte, end byte. ``separator`` (a flag per byte value) makes words of other runs, such as lines."""
    row, begin, end = places(data, offsets, separator)
    return span_hashes(data, begin, end, tables()[3 if lower else 2]), row, begin, end


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, by each byte's ``value``; spans are in order and don't overlap.

    Long slices are hashed in segments, to bound memory.
    """
    hashes = np.zeros(len(begin), np.uint64)
    odd = MULT | 1
    inverse = pow(odd, -1, 1 << 64)
    w = 0
    with np.errstate(over="ignore"):
        while w < len(begin):
            v = max(w + 1, int(np.searchsorted(end, begin[w] + SEGMENT, side="right")))
            a, b = begin[w], end[v - 1]
            forward, back = powers(b - a, odd), powers(b - a, inverse)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(value[data[a:b]] * forward, out=total[1:])
            hashes[w:v] = mix((total[end[w:v] - a] - total[begin[w:v] - a]) * back[begin[w:v] - a])
            w = v
    return hashes


def bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin and end: ``rows + 1`` positions."""
    return np.searchsorted(row, np.arange(rows + 1))


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a row, and the position of their first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out = out * np.uint64(MULT) + hashes[j : j + n]
        at = np.flatnonzero(row[:n] == row[width - 1 :])
        return mix(out[at]), at


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words; a shorter row has its whole sequence as one. Ordered by row."""
    found, at = windows(hashes, row, width)
    of = row[at]
    edge = bounds(row, rows)
    size = np.diff(edge)
    short = np.flatnonzero((size > 0) & (size < width))
    if not len(short):
        return found, of
    with np.errstate(over="ignore"):
        extra = np.array([mix(np.array([_fold(hashes[edge[r] : edge[r + 1]])], np.uint64))[0] for r in short], np.uint64)
    found, of = np.concatenate([found, extra]), np.concatenate([of, short])
    order = np.argsort(of, kind="stable")
    return found[order], of[order]


def _fold(hashes: np.ndarray) -> int:
    out = len(hashes)
    for h in hashes.tolist():
        out = (out * MULT + h) & 0xFFFFFFFFFFFFFFFF
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
