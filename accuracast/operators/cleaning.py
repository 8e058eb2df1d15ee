"""Cleaning, gap filling, positions, differencing and calendar columns of a panel."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accuracast.functions.calendar import WEEKDAYS
from accuracast.functions.columns import ID, finite, over, whole

TO_DATE = (Window.unboundedPreceding, 0)
FROM_NOW = (0, Window.unboundedFollowing)


def drop_empty_series(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Drop series without any finite value."""
    return panel.withColumn("_n", F.count(finite("y")).over(whole(keys))).where("_n > 0").drop("_n")


def dedup_keep_last(rows: DataFrame, order: str, keys: Sequence[str] = ("series_id", "ts")) -> DataFrame:
    """Keep the row ingested last per key; an aggregate, so duplicates shrink before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by("y", order).alias("y"))


def index_positions(rows: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(over(keys, "ts")).cast("bigint") - 1)


def select_series(df: DataFrame, chosen: DataFrame, on: str = "series_id") -> DataFrame:
    return df.join(chosen.select(on).distinct(), on, "left_semi")


def parse_model_key(df: DataFrame, column: str = "model_key") -> DataFrame:
    """``model|horizon|series`` → its parts, read from the right."""
    parts = F.split(F.col(column), r"\|")
    return df.select(
        "*",
        F.element_at(parts, 1).alias("model"),
        F.element_at(parts, -2).cast("int").alias("horizon"),
        F.element_at(parts, -1).alias("series"),
    )


def downsample_stride(panel: DataFrame, max_points: int = 20000, keys: Sequence[str] = ID) -> DataFrame:
    """Every k-th non-null point, k chosen per series so about ``max_points`` stay."""
    numbered = panel.where(F.col("y").isNotNull()).select(
        "*",
        (F.row_number().over(over(keys)).cast("bigint") - 1).alias("_i"),
        F.count(F.lit(1)).over(whole(keys)).alias("_n"),
    )
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max_points))
    return numbered.where(F.col("_i") % step == 0).drop("_i", "_n")


def finite_only(panel: DataFrame) -> DataFrame:
    return panel.withColumn("y", finite("y")).where(F.col("y").isNotNull())


def leading_zeros_to_null(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Zeros before the first non-zero are unknown. A missing value counts as non-zero."""
    seen = F.max(F.when(F.col("y").isNull() | (F.col("y") != 0), 1)).over(over(keys).rowsBetween(*TO_DATE))
    return panel.withColumn("y", F.when((F.col("y") == 0) & seen.isNull(), None).otherwise(F.col("y")))


def cut_last_non_null(panel: DataFrame, k: int, keys: Sequence[str] = ID) -> DataFrame:
    """The last k non-null values of each series become NULL."""
    later = F.count("y").over(over(keys).rowsBetween(*FROM_NOW))
    return panel.withColumn("y", F.when(later > k, F.col("y")))


def ffill_bfill(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    before = F.last("y", True).over(over(keys).rowsBetween(*TO_DATE))
    after = F.first("y", True).over(over(keys).rowsBetween(*FROM_NOW))
    return panel.withColumn("y", F.coalesce(before, after))


def median_fill(df: DataFrame, keys: Sequence[str] = ID, value: str = "y") -> DataFrame:
    """NULL → median of the group, 0 when the group has none."""
    return df.withColumn(value, F.coalesce(F.col(value), F.median(value).over(whole(keys)), F.lit(0.0)))


def trim_edge_nulls(panel: DataFrame) -> DataFrame:
    """Drop leading and trailing positions where all series are NULL."""
    known = panel.where(F.col("y").isNotNull()).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    lo, hi = known.select("lo").scalar(), known.select("hi").scalar()
    return panel.where((F.col("pos") >= lo) & (F.col("pos") <= hi))


def holdout_split(panel: DataFrame, h: int, keys: Sequence[str] = ID) -> DataFrame:
    """Mark the last h positions of each series as horizon, the rest as past."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("pos").desc()))
    return panel.withColumn("part", F.when(back <= h, "horizon").otherwise("past"))


def difference(panel: DataFrame, times: int = 1, lag: int = 1, keys: Sequence[str] = ID) -> DataFrame:
    """Lag differencing, repeated; rows without a predecessor are dropped each time."""
    for _ in range(times):
        panel = panel.withColumn("y", F.col("y") - F.lag("y", lag).over(over(keys))).where(F.col("y").isNotNull())
    return panel


def mix32(x: Column) -> Column:
    """Integer hash of a non-negative BIGINT below 2^32 (the usual xor-multiply mix)."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(73244475).cast("bigint")) % F.lit(4294967296)
    return x.bitwiseXOR(F.shiftright(x, 16))


def uniform_hash(seed: int, stream: Column, i: Column) -> Column:
    """Reproducible 24-bit draw per (seed, stream, i); the same on any partitioning."""
    start = F.lit(seed * 1000003 + 1) + stream.cast("bigint") * 7919 + i.cast("bigint") * 104729
    return F.shiftright(mix32(start % F.lit(4294967296)), 8)


def jitter_constant(panel: DataFrame, seed: int = 0, keys: Sequence[str] = ID) -> DataFrame:
    """Constant series get noise of size 1e-9, so rank statistics stay defined."""
    u1 = (uniform_hash(seed, F.lit(1), F.col("pos")) + 1) / 16777217.0
    u2 = uniform_hash(seed, F.lit(2), F.col("pos")) / 16777216.0
    normal = F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    constant = F.min("y").over(whole(keys)) == F.max("y").over(whole(keys))
    return panel.withColumn("noise", F.when(constant, normal).otherwise(0.0)).withColumn("y", F.col("y") + F.col("noise") * 1e-9)


def infer_frequency(index: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Alias of a regular step per series (H, D, W-MON, MS, QS, YS), NULL when irregular."""
    w = over(keys, "ts")
    prev = F.lag("ts").over(w)
    rows = index.select(*keys, "ts", F.timestamp_diff("SECOND", prev, F.col("ts")).alias("gap"), F.timestamp_diff("MONTH", prev, F.col("ts")).alias("months"))
    first_of_month = (F.dayofmonth("ts") == 1) & (F.hour("ts") == 0) & (F.minute("ts") == 0) & (F.second("ts") == 0)
    g = rows.groupBy(*keys).agg(
        F.count("ts").alias("n"),
        F.min("gap").alias("lo"), F.max("gap").alias("hi"),
        F.min("months").alias("mlo"), F.max("months").alias("mhi"),
        F.bool_and(first_of_month).alias("month_start"),
        F.min(F.weekday("ts")).alias("weekday"),
    )
    weekday = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday") + 1)
    same, day = F.col("lo") == F.col("hi"), 86400
    monthly = F.col("month_start") & (F.col("mlo") == F.col("mhi"))
    alias = (
        F.when(F.col("n") < 3, None)
        .when(same & (F.col("lo") == 7 * day), F.concat(F.lit("W-"), weekday))
        .when(same & (F.col("lo") == day), "D")
        .when(same & (F.col("lo") == 3600), "H")
        .when(same & (F.col("lo") == 60), "T")
        .when(same & (F.col("lo") == 1), "S")
        .when(monthly & (F.col("mlo") == 1), "MS")
        .when(monthly & (F.col("mlo") == 3), "QS")
        .when(monthly & (F.col("mlo") == 12), "YS")
        .when(same & (F.col("lo") % (7 * day) == 0), F.concat((F.col("lo") / (7 * day)).cast("int").cast("string"), F.lit("W-"), weekday))
        .when(same & (F.col("lo") % day == 0), F.concat((F.col("lo") / day).cast("int").cast("string"), F.lit("D")))
        .when(same & (F.col("lo") % 3600 == 0), F.concat((F.col("lo") / 3600).cast("int").cast("string"), F.lit("H")))
    )
    return g.select(*keys, alias.alias("freq"))


def dataset_summary(panel: DataFrame) -> DataFrame:
    freq = infer_frequency(panel.select(F.lit("all").alias("series_id"), "ts").distinct()).select("freq").scalar()
    return panel.agg(
        F.count_distinct("ts").alias("n_rows"),
        F.count_distinct("series_id").alias("n_series"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("y").alias("n_values"),
    ).withColumn("freq", freq)


def future_index(panel: DataFrame, h: int, step: str, keys: Sequence[str] = ID) -> DataFrame:
    """The next h positions and timestamps of every series."""
    ends = panel.groupBy(*keys).agg(F.max("pos").alias("_p"), F.max("ts").alias("_t"))
    k = F.col("k")
    moved = {
        "hour": F.col("_t") + F.make_dt_interval(hours=k),
        "day": F.col("_t") + F.make_dt_interval(days=k),
        "week": F.col("_t") + F.make_dt_interval(days=k * 7),
        "month": F.col("_t") + F.make_ym_interval(months=k),
        "quarter": F.col("_t") + F.make_ym_interval(months=k * 3),
        "year": F.col("_t") + F.make_ym_interval(years=k),
    }[step]
    return ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h)))).select(*keys, (F.col("_p") + k).alias("pos"), moved.alias("ts"))


def periodic_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    weekday, month = F.weekday(ts), F.month(ts)
    return df.select(
        "*",
        weekday.alias("weekday"), month.alias("month"),
        F.sin(2 * math.pi * weekday / 7).alias("weekday_sin"), F.cos(2 * math.pi * weekday / 7).alias("weekday_cos"),
        F.sin(2 * math.pi * month / 12).alias("month_sin"), F.cos(2 * math.pi * month / 12).alias("month_cos"),
    )
