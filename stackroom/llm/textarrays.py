"""Whole texts of an Arrow column as byte arrays, cut into tokens, lines and windows with numpy.

These helpers run inside a task, on the rows Spark hands to it. A batch is taken apart into slices of a few
megabytes, so the working memory of a task follows the slice (or one very long text), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A lookup table, true for the bytes within the spans (both ends included)."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low:high + 1] = True
    return table


#: Bytes that end a word of ``[^\x20\x09-\x0D]+``.
BLANK = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch holding about ``limit`` bytes of text; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if len(sizes) == 0:
        return
    part = np.cumsum(sizes, dtype=np.int64) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)]):
        yield batch.slice(low, high - low)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    large = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(large)
    offsets = np.frombuffer(large.buffers()[1], np.int64, n + 1, large.offset * 8) if n else np.zeros(1, np.int64)
    store = large.buffers()[2]
    if store is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(store, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross rows: starts, ends, and the number of runs in each row."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1024, 1 << int(n - 1).bit_length())
            up, down = np.full(size, _BASE, _U), np.full(size, _BASE_INVERSE, _U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply, shift, multiply)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`span_hashes` takes the hash of any span."""
    up, _ = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, the same wherever its bytes stand."""
    _, down = _POWERS.upto(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` tokens within a row, and the token it begins with."""
    if len(hashes) < size:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(rows[:len(rows) - size + 1] == rows[size - 1:])
    total = np.zeros(len(at), _U)
    for k in range(size):
        total = total * _U(0xFF51AFD7ED558CCD) + hashes[at + k]
        total ^= total >> _U(29)
    return mixed(total), at


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, rows without any give 0."""
    ends = np.cumsum(counts)
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[ends] - sums[ends - counts]
