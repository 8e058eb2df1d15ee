"""Train/test windows over a panel: overlapping, train/val/test and meta-learning cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accuracast.functions.columns import ID, over, whole
from accuracast.operators.cleaning import ffill_bfill

SPLITS = ["train", "val", "test"]


def split_windows(panel: DataFrame, n: int, h: int, pct: float = 0.8, keys: Sequence[str] = ID) -> DataFrame:
    """Up to n overlapping windows per series, each window_id a shifted copy with local positions.

    A row is emitted once per window it belongs to, so no join is needed.
    """
    length = F.count(F.lit(1)).over(whole(keys))
    local = F.col("pos") - F.min("pos").over(whole(keys))
    rows = panel.select("*", length.alias("_t"), local.alias("_p")).where(F.col("_t") > h)
    size = F.greatest(F.lit(h + 1), F.least(F.col("_t"), h + F.bround(pct * F.col("_t"), 0).cast("bigint")))
    rows = rows.withColumn("_l", size).withColumn("_n", F.least(F.lit(n), F.greatest(F.lit(1), F.col("_t") - F.col("_l") + 1)))
    first = F.greatest(F.lit(0), F.col("_p") - F.col("_l") + 1)
    last = F.least(F.col("_n") - 1, F.col("_p"))
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    out = rows.withColumn("_i", F.explode(starts)).select(
        *keys, (F.col("_i") + 1).cast("int").alias("window_id"), (F.col("_p") - F.col("_i")).alias("pos"), "ts", "y",
        F.when(F.col("_p") - F.col("_i") >= F.col("_l") - h, "horizon").otherwise("past").alias("part"),
    )
    return ffill_bfill(out, [*keys, "window_id"])


def choose_layout(total: int, n: int = 5, h: int = 26, step_unit: int = 52, base_blocks: int = 4) -> tuple[int, int]:
    """Window length and inner step for n windows in each of three splits; scalars only.

    Three splits need 3 (n - 1) inner steps of one point or more beside a window and two horizons. A
    window of ``base_blocks`` units gives up as many units as that room lacks.
    """
    steps = 3 * (n - 1)
    longest = min(base_blocks * step_unit, total)
    lacking = max(steps, 1) - (total - 2 * h - longest)
    length = longest - max(0, -(-lacking // step_unit)) * step_unit
    if length <= 0:
        raise ValueError("the series are too short for the requested windows")
    return length, (total - 2 * h - length) // steps if steps else 1


def split_bounds(total: int, n: int, h: int, **layout) -> list[tuple[str, int, int, int]]:
    """(split, window_id, start, end) of every window; horizons of different splits never overlap.

    Window i (from 0) of the split that is s places before the last one ends at
    total - s ((n - 1) step + h) - i step.
    """
    length, step = choose_layout(total, n, h, **layout)
    places = [(s, i, total - s * ((n - 1) * step + h) - i * step) for s in range(len(SPLITS)) for i in range(n)]
    return [(SPLITS[-1 - s], i + 1, end - length, end) for s, i, end in places]


def train_val_test(panel: DataFrame, n: int = 5, h: int = 26, keys: Sequence[str] = ID, **layout) -> DataFrame:
    """Windows of all three splits with local positions; only the series length reaches the driver."""
    total = panel.agg(F.max("pos") - F.min("pos") + 1).first()[0]
    bounds = split_bounds(int(total), n, h, **layout)
    entries = F.array(*[
        F.struct(F.lit(s).alias("split"), F.lit(w).alias("window_id"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
        for s, w, a, b in bounds
    ])
    hit = F.filter(entries, lambda e: (F.col("pos") >= e["a"]) & (F.col("pos") < e["b"]))
    rows = panel.withColumn("_w", F.explode(hit)).select(
        F.col("_w.split").alias("split"), *keys, F.col("_w.window_id").alias("window_id"), (F.col("pos") - F.col("_w.a")).alias("pos"), "ts", "y",
        F.when(F.col("pos") >= F.col("_w.b") - h, "horizon").otherwise("past").alias("part"),
    )
    return ffill_bfill(rows, ["split", *keys, "window_id"])


def window_series(windows: DataFrame) -> DataFrame:
    """Treat every window of a series as a series of its own, as the study does."""
    return windows.select(
        "split", F.concat_ws("_", "series_id", F.col("window_id").cast("string")).alias("series_id"),
        F.col("series_id").alias("source_id"), "window_id", "pos", "ts", "y", "part",
    )


def meta_windows(panel: DataFrame, n: int, h: int, keys: Sequence[str] = ID) -> DataFrame:
    """Up to n windows per series, at least 2h training points and exactly h test points each."""
    rows = panel.select("*", F.count(F.lit(1)).over(whole(keys)).alias("_len"), (F.row_number().over(over(keys)).cast("bigint") - 1).alias("_p"))
    rows = rows.withColumn("_n", F.least(F.lit(n), F.col("_len") - 3 * h)).where("_n > 0")
    # window w covers [w, len - (n_w - w - 1)): its last h points are the test part
    rows = rows.withColumn("w", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    end = F.col("_len") - (F.col("_n") - F.col("w") - 1)
    return rows.where((F.col("_p") >= F.col("w")) & (F.col("_p") < end)).select(
        *keys, (F.col("w") + 1).alias("window_id"), (F.col("_p") - F.col("w")).alias("pos"), "ts", "y",
        F.when(F.col("_p") >= end - h, "horizon").otherwise("past").alias("part"),
        F.col("w").cast("bigint").alias("window_start"), (end - h - F.col("w")).alias("window_length"),
    )


def time_split(design: DataFrame, share: float = 0.2, keys: Sequence[str] = ID) -> DataFrame:
    """Last max(1, floor(share * n)) rows per series are validation."""
    n = F.count(F.lit(1)).over(whole(keys))
    v = F.greatest(F.lit(1), F.floor(n * share))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("pos").desc()))
    return design.withColumn("is_validation", back <= v)
