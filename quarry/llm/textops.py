"""Vectorised text primitives: whole Arrow string columns as one byte buffer with offsets.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; these are ASCII,
so byte positions and character positions cut the same words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
SLICE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.RandomState(20260101).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

_powers: dict[str, np.ndarray] = {}
_kept: dict[str, object] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i in [0, n)."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def kept(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, one thing at a time: see ``slices``."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one holds about ``limit`` bytes of ``column``, one row at least.

    Work on a slice takes some tens of bytes per byte of text, so small slices bound a worker's memory.
    Workers serve one operator after another; what another one kept under another name than ``keep`` goes.
    """
    for key in [k for k in _kept if k != keep]:
        del _kept[key]
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if not batch.num_rows:
            continue
        _, offsets = string_buffer(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def counts_by_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many set positions each row's byte range has."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """The words of every row of a buffer: byte ranges, row ranges and hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        solid = ~SPACE[raw]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:n]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | first[1:n]
        self.starts = np.flatnonzero(begins)
        self.stops = np.flatnonzero(ends) + 1
        self.rows = np.searchsorted(self.starts, offsets)  # words of row i: rows[i]..rows[i+1]
        self.per_row = np.diff(self.rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_row)), self.per_row)

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, dtype=U64)
        np.cumsum(BYTE_VALUES[self.raw] * up[:-1], out=total[1:])
        return mix((total[self.stops] - total[self.starts]) * down[self.starts])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words inside a row, and the index of their first word."""
        h, n = self.hashes(), len(self.starts)
        if n < size:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        left = np.repeat(self.rows[1:], self.per_row) - np.arange(n)  # words from here to the row's end
        at = np.flatnonzero(left >= size)
        value = np.zeros(len(at), dtype=U64)
        for k in range(size):
            value = mix(value * U64(0x9FB21C651E98DF25) + h[at + k] + U64(k))
        return value, at


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    upper = (raw >= 65) & (raw <= 90)
    return np.where(upper, raw + np.uint8(32), raw) if upper.any() else raw


def ints(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, byte by byte, and compressed; the first byte tells."""
    size = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def whole(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : blob[0]] = planes.T
    return out.reshape(-1).view("<u8")
