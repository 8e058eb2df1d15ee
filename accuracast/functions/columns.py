"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ["series_id"]


def rnd(col: Column | str, places: int = 6) -> Column:
    """Half-even rounding, the rounding rule of every reported value."""
    return F.bround(F.col(col) if isinstance(col, str) else col, places)


def finite(col: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def over(keys: Sequence[str] = ID, order: Sequence[str] | str = "pos"):
    """Window over one series in time order."""
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def whole(keys: Sequence[str] = ID):
    """Window over one whole series."""
    return Window.partitionBy(*keys)


def avg_rank(keys: Sequence[str], value: str, ascending: bool = True) -> Column:
    """Rank from 1, ties share the mean of their positions."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    ranked = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return ranked + (ties - 1) / 2.0


def varies(x: Column | str) -> Column:
    """Aggregate test: the group holds at least two different values."""
    return F.coalesce(F.min(x) < F.max(x), F.lit(False))


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side (the built-in raises there)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    # merged partial variances of equal values are not always exactly 0, so compare the extremes
    return F.when(varies(x) & varies(y), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


# ---- array helpers: one row holds one series (bounded by its calendar) -------------------------


def series_arrays(df: DataFrame, keys: Sequence[str] = ID, value: str = "y", order: str = "pos") -> DataFrame:
    """One row per series: ``ys`` in time order without NULLs, ``n``, ``mu`` and ``sd``; one shuffle."""
    packed = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_s"),
        F.count(value).alias("n"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"), F.max(value).alias("hi"),
    )
    return packed.select(*keys, F.transform("_s", lambda s: s["v"]).alias("ys"), "n", "mu", "sd", "lo", "hi")


def with_deviations(arrays: DataFrame) -> DataFrame:
    """Add ``es``, the values less their mean."""
    return arrays.withColumn("es", F.transform("ys", lambda v: v - F.col("mu")))


def pluck(arr: Column, field: str) -> Column:
    """One field of every struct in an array."""
    return F.transform(arr, lambda s: s[field])


def total(arr: Column | str) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, total(arr) / F.size(arr))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def tail(arr: Column, skip: Column) -> Column:
    """Everything after the first ``skip`` elements."""
    return F.slice(arr, (skip + 1).cast("int"), F.greatest(F.size(arr) - skip, F.lit(0)).cast("int"))


def head(arr: Column, drop: Column) -> Column:
    """Everything but the last ``drop`` elements."""
    return F.slice(arr, F.lit(1), F.greatest(F.size(arr) - drop, F.lit(0)).cast("int"))


def lag_dot(arr: Column, k: Column) -> Column:
    """Sum of x[t] * x[t-k]."""
    return dot(head(arr, k), tail(arr, k))


def sorted_quantile(arr: Column, q: float) -> Column:
    """Linear-interpolation quantile of an already sorted array; NULL when it is empty."""
    at = (F.size(arr) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a = F.get(arr, F.greatest(low, F.lit(0)))
    b = F.get(arr, F.greatest(F.least(low + 1, F.size(arr) - 1), F.lit(0)))
    return F.when(F.size(arr) > 0, a + (b - a) * (at - low))


def first_diff(arr: Column) -> Column:
    """First differences of an array."""
    return F.zip_with(tail(arr, F.lit(1)), head(arr, F.lit(1)), lambda x, y: x - y)
