"""Whole Arrow text columns as byte arrays, cut into pieces without a loop over rows.

A text column is one byte buffer with row offsets. A table over byte pairs says where a piece
ends, so cutting, dictionary encoding and all later work are array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
IS_TAIL = (np.arange(256) & 0xC0) == 0x80  # continuation bytes of UTF-8
#: Cuts wherever white space begins or ends.
SPACE_CUTS = (IS_SPACE[:, None] != IS_SPACE[None, :]).ravel()


@dataclass
class Pieces:
    """``row[i]`` and ``code[i]`` of the i-th piece; ``values`` holds each distinct piece once."""

    row: np.ndarray
    code: np.ndarray
    values: pa.Array
    n_rows: int

    def __len__(self) -> int:
        return len(self.code)

    def row_offsets(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))

    def per_row(self, weight: np.ndarray) -> np.ndarray:
        """Sum of a weight per distinct piece over the pieces of each row."""
        return np.bincount(self.row, weights=weight[self.code], minlength=self.n_rows)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``most`` bytes of text; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def cut(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, skip_spaces: bool = False) -> Pieces:
    """Pieces between the cuts of ``cuts[256 * left + right]`` and the ends of rows."""
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        return Pieces(np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_binary()), rows)
    mark = np.zeros(n + 1, dtype=bool)
    mark[1:n] = cuts[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    mark[offsets] = True
    start = np.flatnonzero(mark[:n])
    encoded = binary(data, np.append(start, n).astype(np.int64)).dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False)
    if skip_spaces:
        keep = ~IS_SPACE[data[start]]
        start, code = start[keep], code[keep]
    row = np.searchsorted(offsets, start, side="right") - 1
    return Pieces(row, code, encoded.dictionary, rows)


def words(column: pa.Array, lower: bool = True) -> Pieces:
    """Runs of anything but ASCII white space, with A-Z lower-cased if asked."""
    data, offsets = utf8(column)
    return cut(LOWER[data] if lower else data, offsets, SPACE_CUTS, skip_spaces=True)


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array without nulls."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(values) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


_MIX = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash64(values: pa.Array) -> np.ndarray:
    """64-bit polynomial hash of each value; the same in every task."""
    data, at = flat(values)
    lengths = np.diff(at)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    position = np.arange(len(data)) - np.repeat(at[:-1], lengths)
    terms = _MIX[data] * powers(int(lengths.max(initial=0)))[position]
    running = np.append(np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64))
    return finish((running[at[1:]] - running[at[:-1]]) * _BASE + lengths.astype(np.uint64))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` token hashes, position by position."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weight = powers(width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += tokens[k : k + n] * weight[k + 1]
    return finish(out)
