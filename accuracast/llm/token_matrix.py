"""Packed id matrices: best-fit-decreasing with a segment tree over free capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from accuracast.llm.textarrays import released
from accuracast.llm.tokens import id_width, token_ids

CAPACITY = 2048
#: Ids gathered before a block of sequences is packed: the memory of a task.
BLOCK_IDS = 4_000_000


class FreeSpace:
    """Open bins by free capacity; a segment tree answers which is the least that still suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def _add(self, free: int, n: int) -> None:
        at = free + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def put(self, number: int, free: int) -> None:
        if free:
            self.bins.setdefault(free, []).append(number)
            self._add(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, free) of the fullest bin with room for ``size``; it is no longer open."""
        at = size + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return self.bins[free].pop(), free


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Items of each bin. Items are taken from the largest down, equal ones in order."""
    space, bins = FreeSpace(capacity), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = space.take(size)
        if found is None:
            found = (len(bins), capacity)
            bins.append([])
        bins[found[0]].append(i)
        space.put(found[0], found[1] - size)
    return bins


def _pack(keys: pa.Array, ids: list[np.ndarray], capacity: int, pad: int, first: int) -> pa.RecordBatch:
    """Pieces of at most ``capacity`` ids, whole rows first, packed into a matrix."""
    text, start, length = [], [], []
    for i, x in enumerate(ids):
        for a in range(0, len(x), capacity):
            text.append(i), start.append(a), length.append(min(capacity, len(x) - a))
    bins = best_fit_decreasing(np.array(length, np.int64), capacity)
    matrix = np.full((len(bins), capacity), pad, ids[0].dtype)
    positions = np.zeros((len(bins), capacity), ids[0].dtype)
    ramp = np.arange(capacity, dtype=ids[0].dtype)
    edges, order = [], []
    for row, items in enumerate(bins):
        at = 0
        edge = [0]
        for i in items:
            n = length[i]
            matrix[row, at : at + n] = ids[text[i]][start[i] : start[i] + n]
            positions[row, at : at + n] = ramp[:n]
            at += n
            edge.append(at)
        edges.append(edge), order.extend(items)
    lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)
    at = np.array(order, np.int64)
    sizes = [len(b) for b in bins]
    columns = {
        "sequence_id": pa.array(np.arange(first, first + len(bins))), "n_ids": pa.array([e[-1] for e in edges], pa.int32()),
        "input_ids": pa.array([r.tobytes() for r in matrix], pa.binary()), "position_ids": pa.array([r.tobytes() for r in positions], pa.binary()),
        "cu_seqlens": lists(pa.array([x for e in edges for x in e], pa.int32()), [len(e) for e in edges]),
        "keys": lists(keys.take(pa.array(np.array(text, np.int64)[at])), sizes), "starts": lists(pa.array(np.array(start, np.int64)[at]), sizes),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def packed_matrices(df: DataFrame, key: str = "series_id", text: str = "text", capacity: int = CAPACITY, pad: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per sequence: a row of the id matrix with what a trainer needs to keep its texts apart.

    ``input_ids`` and ``position_ids`` are ``capacity`` little-endian integers (16 bits where the
    vocabulary allows, else 32), padded with ``pad`` and 0 behind ``n_ids``; positions begin anew with
    every piece. ``cu_seqlens`` holds the cumulative piece lengths from 0 to ``n_ids``. Piece i belongs
    to ``keys[i]`` and begins at id ``starts[i]`` of it, so sorting pieces by key and start gives back
    every text's ids.

    General operator: the project has no running text. A text gets the end id after its own; one longer
    than ``capacity`` is cut into whole rows and a rest, losing nothing. NULL and empty texts are their
    end id alone, repeated rows are packed one by one, and an empty table gives no sequence.

    Scale: texts are encoded and packed where they are read, in blocks of four million ids, so nothing
    is shuffled and a task holds one block. Only the last sequences of a block lack ids to fill them.
    Ids follow the partition and the block, so a lost task gives the same rows again.
    """
    rows = token_ids(df, key, text, tokenizer)
    width = np.dtype(id_width(tokenizer))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        keys, ids, held = [], [], 0

        def block():
            return _pack(pa.concat_arrays(keys), ids, capacity, pad, first)

        for batch in released(batches):
            keys.append(batch.column("key"))
            for x in batch.column("ids"):
                ids.append(np.frombuffer(x.as_buffer(), width))
                held += len(ids[-1])
            if held >= BLOCK_IDS:
                out = block()
                keys, ids, held, first = [], [], 0, first + out.num_rows
                yield out
        if ids:
            yield block()

    return rows.mapInArrow(
        run, f"sequence_id bigint, n_ids int, input_ids binary, position_ids binary, cu_seqlens array<int>, keys array<{kind}>, starts array<bigint>"
    )
