"""Whole Arrow batches of text as numpy arrays: word borders, 64-bit word hashes and slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 8 << 20
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: space and the five ASCII control characters from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes outside words of letters: ASCII that is no letter. Bytes of other characters count as letters.
NO_LETTER = np.array([not (b >= 128 or chr(b).isalpha()) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
LOWER_VALUE = BYTE_VALUE[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    return _powers(BASE, 2 * BLOCK), _powers(pow(BASE, -1, 1 << 64), 2 * BLOCK)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part, first = np.cumsum(sizes) // limit, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
            if end > first:
                yield batch.slice(first, end - first)
            first = end


def word_borders(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of every maximal run of bytes that are not ``apart``; no run crosses a row."""
    inside = ~apart[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds)))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for ordered spans that do not overlap; equal content gives equal hashes."""
    forth, back = tables = tables or power_tables()
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(int(np.searchsorted(end, start[i] + 2 * BLOCK, "right")), i)
            if j == i:  # one span longer than the tables: hash its pieces
                piece = np.arange(start[i], end[i], BLOCK)
                parts = span_hashes(values, piece, np.minimum(piece + BLOCK, end[i]), tables)
                acc = np.uint64(0)
                for p in parts:
                    acc = mix(acc * np.uint64(BASE) + p)
                out[i] = acc
                i += 1
                continue
            a, b = int(start[i]), int(end[j - 1])
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values[a:b] * forth[: b - a], out=total[1:])
            out[i:j] = (total[end[i:j] - a] - total[start[i:j] - a]) * back[start[i:j] - a]
            i = j
        return mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, A-Z taken as a-z."""
    start, end, row = word_borders(data, bounds, apart)
    out = np.empty(len(start), np.uint64)
    step, tables = 1 << 16, power_tables()
    for i in range(0, len(start), step):
        s, e = start[i : i + step], end[i : i + step]
        a = int(s[0])
        out[i : i + step] = span_hashes(LOWER_VALUE[data[a : int(e[-1])]], s - a, e - a, tables)
    return out, row
