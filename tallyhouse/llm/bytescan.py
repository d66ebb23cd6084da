"""Numpy scans over the UTF-8 bytes of many texts at once: hashes of substrings, words and their places."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random number per byte value, and two odd bases of the hashes.
BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = [int(x) * 2 + 1 for x in _RNG.integers(1 << 61, 1 << 62, 2)]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[base] = have
    return have[:n]


class Hashes:
    """Hash of any substring of ``data`` in constant time: a polynomial in the byte values modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, base: int = 0):
        n = len(data)
        self.up = powers(BASES[base], n + 1)
        down = powers(pow(BASES[base], -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[data] * down[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without copies, and where each row begins and the last ends. No nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, first = len(column), column.offset
    places = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[first : first + n + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def chunks(
    batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 1 << 20
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        data, off = text_bytes(column)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            j = min(j, i + 60_000, batch.num_rows)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of bytes without separators, within one row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = separator[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = edge.copy(), edge
    before[1:] |= gap
    after[:-1] |= gap
    start = np.flatnonzero(~gap & before[:-1])
    end = np.flatnonzero(~gap & after[1:]) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours; len(x) - width + 1 values."""
    n = len(x)
    top = np.iinfo(x.dtype).max
    rows = np.full(-(-n // width) * width, top, x.dtype)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    first = np.cumsum(length) - length
    some = length > 0
    at, begin, size = first[some], start[some], length[some]
    out[at[0]] = begin[0]
    out[at[1:]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def distinct_by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted by row and value. Fewer than 65,536 rows."""
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
