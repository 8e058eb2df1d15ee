"""Exact nearest points: boxes of neighbouring points, of which only those within reach are searched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accuracast.session import written

#: Training points of a box on average; at twice as many it is split.
BOX_ROWS = 2048
#: Boxes of the first cut, and points per box sampled for it: what the driver holds is bounded by their product.
MAX_LEAVES = 16384
LEAF_SAMPLE = 16
CHUNK = 256


def split_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of the inner nodes of a complete binary tree: the widest axis of a node at its median."""
    axis, cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    held = {0: sample}
    for node in range(2**depth - 1):
        x = held.pop(node)
        if len(x):
            axis[node] = x.std(axis=0).argmax()
            cut[node] = np.median(x[:, axis[node]])
        right = x[:, axis[node]] > cut[node]
        held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
    return axis, cut


def leaf_of(x: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range((len(axis) + 1).bit_length() - 1):
        at = 2 * at + 1 + (x[rows, axis[at]] > cut[at])
    return at - len(axis)


def _norm(terms: Iterator[np.ndarray]) -> np.ndarray:
    # distances and reaches add their squares in the same order, and rounding keeps the order of
    # sums: no box is computed to be farther away than one of its points
    return np.sqrt(sum(t**2 for t in terms))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _norm(x[:, None, j] - y[None, :, j] for j in range(x.shape[1]))


class Boxes:
    """Corners and sizes of the boxes of the training points."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: np.ndarray):
        self.low, self.high, self.n = low, high, n

    def nearest_side(self, x: np.ndarray) -> np.ndarray:
        """The least distance of a point to anything in a box."""
        return _norm(np.maximum(0.0, np.maximum(self.low[None, :, j] - x[:, None, j], x[:, None, j] - self.high[None, :, j])) for j in range(x.shape[1]))

    def farthest_side(self, x: np.ndarray) -> np.ndarray:
        return _norm(np.maximum(x[:, None, j] - self.low[None, :, j], self.high[None, :, j] - x[:, None, j]) for j in range(x.shape[1]))

    def reach(self, x: np.ndarray, k: int) -> np.ndarray:
        """A distance within which k points are sure to lie; infinite if there are fewer."""
        far = self.farthest_side(x)
        order = np.argsort(far, axis=1)
        held = np.cumsum(self.n[order], axis=1)
        at = (held < k).sum(axis=1)
        sure = np.take_along_axis(far, np.take_along_axis(order, np.minimum(at, len(self.n) - 1)[:, None], 1), 1)[:, 0]
        return np.where(at < len(self.n), sure, np.inf)


def _closest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k smallest of every row, ties in the order of ``y``."""
    dist = distances(x, y)
    keep = min(k, len(y))
    edge = np.partition(dist, keep - 1, axis=1)[:, keep - 1][:, None]
    closer, tied = dist < edge, dist == edge
    room = keep - closer.sum(axis=1, keepdims=True)
    rows, cols = np.nonzero(closer | (tied & (np.cumsum(tied, axis=1) <= room)))
    return rows, cols, dist[rows, cols]


def _points(df: DataFrame) -> DataFrame:
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select("id", "v").where(F.col("v").isNotNull() & ~odd)


class BoxSearch:
    """The k nearest training points of every target, in two visits.

    Copies among the training points collapse to the k of least id, as no more of them can be in a
    list. A tree over a bounded sample cuts the space into boxes of some 2,000 points; every point is
    placed, and a box that came out too full is split by hash. A target first searches the box it is
    nearest to. The k-th distance found there bounds its list, so it is then sent to those other boxes
    only whose corners let a point lie within it, ties included. ``homes`` holds the first visit: the
    list, the bound and the boxes still to be seen.

    Groups stay small: a box is bounded, and the targets sent to one box are cut into blocks. The
    driver sees the sample and the corners of the boxes, nothing that is kept per point.
    """

    def __init__(self, targets: DataFrame, train: DataFrame, k: int, block_rows: int, box_rows: int = BOX_ROWS):
        self.k, self.block_rows = k, block_rows
        self.spark = train.sparkSession
        same = targets is train
        # stored first: they are counted and then read, and features are costly to derive twice
        targets = written(_points(targets), "points")
        copies = Window.partitionBy("v").orderBy("id")
        points = (targets if same else _points(train)).withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= k)
        points = written(points.select(F.col("id").alias("rid"), F.col("v").alias("rv")), "points")
        n = points.count()
        depth = min(MAX_LEAVES.bit_length() - 1, max(0, -(-n // box_rows) - 1).bit_length())
        if not depth:
            self.train, self.boxes = points.withColumn("box", F.lit(0)), None
            placed, sizes = targets.withColumn("box", F.lit(0)), {0: targets.count()}
        else:
            self.train, self.boxes = self._boxed(points, n, depth, box_rows)
            placed = written(targets.mapInPandas(_home(self.boxes), "id string, v array<double>, box int"), "homes")
            sizes = self._sizes(placed)
        schema = "id string, v array<double>, box int, reach double, near array<double>, train_ids array<string>, others array<int>"
        homes = self._visit(placed, sizes, _first_visit(self.boxes, k), schema)
        self.homes = written(homes, "homes") if depth else homes

    @staticmethod
    def _sizes(rows: DataFrame) -> dict[int, int]:
        return {r.box: r.n for r in rows.groupBy("box").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per box

    def _boxed(self, points: DataFrame, n: int, depth: int, box_rows: int) -> tuple[DataFrame, Boxes]:
        share = min(1.0, LEAF_SAMPLE * 2**depth / n)
        sample = points.select("rv").sample(share, 5).toPandas()["rv"]
        dims = len(points.select("rv").first()["rv"])
        axis, cut = split_tree(np.stack(sample.to_numpy()) if len(sample) else np.empty((0, dims)), depth)

        def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(leaf=leaf_of(np.stack(b["rv"].to_numpy()), axis, cut).astype(np.int32))

        found = written(points.mapInPandas(leaves, "rid string, rv array<double>, leaf int"), "leaves")
        parts = found.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * box_rows)).alias("parts")).orderBy("leaf").toPandas()  # one row per leaf
        layout = self.spark.createDataFrame(list(zip(parts["leaf"].tolist(), (parts["parts"].cumsum() - parts["parts"]).tolist(), parts["parts"].tolist())), "leaf int, first bigint, parts bigint")
        boxed = found.join(layout, "leaf").select("rid", "rv", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts"))).cast("int").alias("box"))
        boxed = written(boxed, "boxes")
        sides = [f(F.col("rv")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(dims)]
        box = boxed.groupBy("box").agg(F.count(F.lit(1)).alias("n"), *sides).toPandas().set_index("box")
        # a box left empty by the hash is infinitely far away
        box = box.reindex(range(int(parts["parts"].sum())))
        corners = [box[[f"{f}{j}" for j in range(dims)]].fillna(np.inf).to_numpy() for f in ("min", "max")]
        return boxed, Boxes(*corners, box["n"].fillna(0).to_numpy())

    def _visit(self, left: DataFrame, sizes: dict[int, int], search: Callable, schema: str) -> DataFrame:
        """``search`` on every box and block of the targets that visit it."""
        full = [(box, -(-n // self.block_rows)) for box, n in sizes.items() if n > self.block_rows]
        blocks = F.lit(1).cast("bigint")
        right = self.train
        if full:
            table = self.spark.createDataFrame(full, "box int, blocks bigint")
            left, right = left.join(table, "box", "left"), right.join(table, "box", "left")
            blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
        left = left.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).drop("blocks")
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).drop("blocks")
        return left.groupBy("box", "block").cogroup(right.groupBy("box", "block")).applyInPandas(search, schema)

    def result(self) -> DataFrame:
        """target_id, train_id, rank and distance."""
        first = self.homes.select(F.col("id").alias("target_id"), F.inline(F.arrays_zip("near", "train_ids"))).select("target_id", F.col("train_ids").alias("train_id"), F.col("near").alias("distance"))
        if self.boxes is not None:
            more = self.homes.select("id", "v", "reach", F.explode("others").alias("box"))
            later = self._visit(more, self._sizes(more), _later_visit(self.k), "target_id string, train_id string, distance double")
            first = first.unionByName(later)
        order = Window.partitionBy("target_id").orderBy("distance", "train_id")
        return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select("target_id", "train_id", "rank", "distance")


def _home(boxes: Boxes) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in (b.iloc[a : a + CHUNK] for a in range(0, len(b), CHUNK)):
                yield part.assign(box=boxes.nearest_side(np.stack(part["v"].to_numpy())).argmin(axis=1).astype(np.int32))

    return run


def _first_visit(boxes: Boxes | None, k: int) -> Callable:
    columns = ["id", "v", "box", "reach", "near", "train_ids", "others"]

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns, dtype=object)
        b = b.sort_values("rid")
        y, ids = np.stack(b["rv"].to_numpy()), b["rid"].to_numpy()
        keep, out = min(k, len(b)), []
        for part in (a.iloc[s : s + CHUNK] for s in range(0, len(a), CHUNK)):
            x = np.stack(part["v"].to_numpy())
            _, cols, dist = _closest(x, y, k)
            near = dist.reshape(len(x), keep)
            others = [[]] * len(x)
            reach = near.max(axis=1)
            if boxes is not None:
                if keep < k:
                    reach = boxes.reach(x, k)
                within = boxes.nearest_side(x) <= reach[:, None]
                within[np.arange(len(x)), part["box"].to_numpy()] = False
                others = [np.flatnonzero(w & (boxes.n > 0)).astype(np.int32) for w in within]
            out.append(pd.DataFrame({"id": part["id"].to_numpy(), "v": list(x), "box": part["box"].to_numpy(), "reach": reach, "near": list(near), "train_ids": list(ids[cols].reshape(len(x), keep)), "others": others}))
        return pd.concat(out, ignore_index=True)

    return search


def _later_visit(k: int) -> Callable:
    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["target_id", "train_id", "distance"], dtype=object)
        b = b.sort_values("rid")
        y, ids, out = np.stack(b["rv"].to_numpy()), b["rid"].to_numpy(), []
        for part in (a.iloc[s : s + CHUNK] for s in range(0, len(a), CHUNK)):
            rows, cols, dist = _closest(np.stack(part["v"].to_numpy()), y, k)
            near = dist <= part["reach"].to_numpy()[rows]
            out.append(pd.DataFrame({"target_id": part["id"].to_numpy()[rows[near]], "train_id": ids[cols[near]], "distance": dist[near]}))
        return pd.concat(out, ignore_index=True)

    return search


def knn(targets: DataFrame, train: DataFrame, k: int, block_rows: int, box_rows: int = BOX_ROWS) -> DataFrame:
    """Exact k nearest training points of every target: target_id, train_id, rank, distance.

    Inputs have (id, v array); points with a missing or infinite coordinate have no distance and are
    left out. Ties are settled by id, so the lists do not depend on the boxes. Fewer than k training
    points give shorter lists, an empty side gives none.
    """
    return BoxSearch(targets, train, k, block_rows, box_rows).result()
