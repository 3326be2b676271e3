"""Vectorised work on Arrow text batches: bounded blocks, word bounds, 64-bit word and shingle hashes.

Everything works on the UTF-8 buffer of a batch, block by block, so that memory is bounded by BLOCK bytes and the
longest single document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time.
BLOCK = 1 << 20
#: Odd multiplier of the polynomial hash, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_bytes = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64)
RAW_CODES = _bytes.copy()
FOLDED_CODES = _bytes.copy()
FOLDED_CODES[65:91] = _bytes[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size > 8 * BLOCK:
            return have
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that polynomial hashes become evenly spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len+1 offsets of a string column; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `limit` bytes of text, or one row."""
    at, n = 0, batch.num_rows
    if not n:
        return
    data, offsets = buffers(batch.column(text))
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (len+1 values).
    Words are maximal runs without space and \\t..\\r and never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edges = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[edges] = ink[edges]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = edges[1:] - 1
    last[edges] = ink[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = FOLDED_CODES) -> np.ndarray:
    """64-bit hash of each word; done in stretches of about BLOCK bytes."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        lo, hi = starts[at], ends[end - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[data[lo:hi]] * powers(BASE, hi - lo), out=sums[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = (sums[e] - sums[s]) * powers(INVERSE, hi - lo)[s] + (e - s).astype(np.uint64)
        at = end
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its distinct k-word shingle hashes in ascending order; fewer words: the whole sequence as one."""
    n = len(words)
    size = np.diff(first)
    step = np.uint64(0x2545F4914F6CDD1D)

    def fold(at: np.ndarray, length: int) -> np.ndarray:
        acc = np.full(len(at), length, np.uint64)
        for j in range(length):
            acc = (acc ^ words[at + j]) * step
            acc ^= acc >> np.uint64(29)
        return mix(acc)

    full = fold(np.arange(max(0, n - k + 1)), k)
    out = []
    short = {length: iter(fold(first[:-1][size == length], length)) for length in range(1, k)}
    for a, m in zip(first[:-1].tolist(), size.tolist()):
        if m >= k:
            own = np.sort(full[a : a + m - k + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        else:
            out.append(np.array([next(short[m])] if m else [], np.uint64))
    return out


def column_long(values) -> pa.Array:
    return pa.array(values, pa.int64())
