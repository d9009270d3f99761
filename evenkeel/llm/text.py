"""Words, hashes and text batches for Arrow tasks.

A word is a run of bytes other than space and 0x09-0x0D, the set that ``bytes.split()``
splits on. Hashes are polynomials over random byte values modulo 2^64, mixed; two lanes
with their own constants make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that the vector code looks at together; one longer text makes a chunk of its own

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without visible structure (the SplitMix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.back = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + n // 4, 1 << 16)
            self.up, self.down = (
                np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]).cumprod(dtype=_U) for b in (self.base, self.back))
        return self.up[:n], self.down[:n]


class Lane:
    """One family of word and sequence hashes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
        bases = [int(b) * 8 + 3 for b in rng.integers(1 << 40, 1 << 60, 2)]
        self.bytes_at, self.words_at = Powers(bases[0]), Powers(bases[1])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.bytes_at.get(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(self.byte[data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])

    def spans(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [start, end)."""
        up, down = self.words_at.get(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, _U)
        np.cumsum(hashes * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


LANES = [Lane(1), Lane(2)]


class Words:
    """The words of some texts in one array: byte ``start`` and ``end`` of each word, and its text's number ``doc``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        here = inside[1:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(here & (~inside[:-2] | edge[:-1]))
        self.end = np.flatnonzero(here & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets[:-1])  # the first word of each text
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.pos = np.arange(len(self.start)) - np.repeat(self.first, self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return LANES[lane].words(self.data, self.start, self.end)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about ``size`` bytes of text: rows, bytes, offsets from 0."""
    data, offsets = buffers(batch.column(column))
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield slice(low, high), data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The texts of a batch as bytes, nulls empty, one at a time."""
    data, offsets = buffers(batch.column(column))
    view = memoryview(data)
    for low, high in zip(offsets[:-1], offsets[1:]):
        yield bytes(view[low:high])
    pa.default_memory_pool().release_unused()


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
