"""Words of a batch of texts as arrays: positions and 64-bit hashes, computed without a loop over words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; only temporary arrays depend on it.
PIECE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that all bits depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_classes(word: Callable[[int], bool]) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte with A-Z lower-cased. No word holds a capital, so
    one of them stands for the byte 0."""
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([(low[b] or 65) if word(low[b]) else 0 for b in range(256)], dtype=np.uint8)


SPACES = {0x20, *range(0x09, 0x0E)}
#: Runs of anything but ASCII white space.
SPACED = byte_classes(lambda b: b not in SPACES)
#: Runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = byte_classes(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)

_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(max(n, PIECE + (1 << 16)), base, U)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers


def _piece_end(data: np.ndarray, classes: np.ndarray, at: int) -> int:
    """End of the piece that begins at ``at``: the first separator after PIECE bytes."""
    end, n = at + PIECE, len(data)
    while end < n:
        gap = np.flatnonzero(classes[data[end : end + 65536]] == 0)
        if len(gap):
            return end + int(gap[0])
        end += 65536
    return n


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, cut: Callable[[np.ndarray, np.ndarray], None] | None = None):
    """(start, end, hash, first): words of all texts in order, and each text's first word (n + 1 entries).

    ``data`` holds the texts' bytes, ``offsets`` (n + 1) where each begins. ``cut(bytes, breaks)`` may set
    further places that no word crosses.
    """
    starts, ends, hashes = [], [], []
    at = int(offsets[0])
    while at < int(offsets[-1]):
        end = min(_piece_end(data, classes, at), int(offsets[-1]))
        m = classes[data[at:end]]
        full = m != 0
        breaks = np.zeros(len(m) + 1, bool)
        breaks[[0, -1]] = True
        lo, hi = np.searchsorted(offsets, [at, end])
        breaks[offsets[lo:hi] - at] = True
        breaks[1:-1] |= full[1:] != full[:-1]
        if cut is not None:
            cut(m, breaks)
        s, e = np.flatnonzero(full & breaks[:-1]), np.flatnonzero(full & breaks[1:]) + 1
        power, inverse = _power_tables(len(m))
        total = np.zeros(len(m) + 1, U)
        np.cumsum(_BYTE[m] * power[: len(m)], out=total[1:])
        starts.append(s + at), ends.append(e + at)
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U)))
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    s = join(starts, np.int64)
    return s, join(ends, np.int64), join(hashes, U), np.searchsorted(s, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; texts run together, so callers cut by ``first``."""
    n = max(0, len(hashes) - k + 1)
    total = hashes[:n] + U(k)
    for j in range(1, k):
        total = total * U(_BASE) + hashes[j : j + n]
    return mix(total)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def released(batches: Iterator) -> Iterator:
    """The same items; at the end of the task freed memory goes back to the system, because Spark keeps
    the worker and the next stage may need the room."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text; a longer text stands alone."""
    for batch in released(batches):
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
