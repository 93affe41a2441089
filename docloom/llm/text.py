"""Vectorised byte-level text kernels over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hashes (invertible modulo 2**64).
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = _LOWER.tobytes()


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of bounded size.

    Yields (first row, end row, bytes, offsets) where row ``first + i`` is
    ``bytes[offsets[i]:offsets[i + 1]]``.  Null is the empty text.  A row
    longer than ``max_bytes`` is a run of its own, whole.
    """
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    n = len(col)
    if not n:
        return
    _, off_buf, data = col.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def separated(buf: np.ndarray, offs: np.ndarray, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Copy of the rows with ``gap`` zero bytes after each; and the row starts there."""
    n = len(offs) - 1
    out = np.zeros(len(buf) + gap * n, np.uint8)
    shift = np.repeat(np.arange(n) * gap, np.diff(offs))
    out[np.arange(len(buf)) + shift] = buf
    return out, offs + np.arange(n + 1) * gap


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(1 << 16, BASE)
_INV = _powers(1 << 16, pow(BASE, -1, 1 << 64))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(m, BASE), _powers(m, pow(BASE, -1, 1 << 64))
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Hashes of any substring of a buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        pw, self.inv = power_tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * pw[: len(buf)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values (64-bit), in order; len(values) - n + 1 of them."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(BASE) + values[k : k + m]
    return mix(h)
