"""Least squares per group and classical decomposition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.functions.columns import ID, over, whole


def gram(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ID) -> DataFrame:
    """Cross products of [1, xs, y] per group in one aggregation.

    Rows collapse to k*k sums before the shuffle (map-side), so group size does not matter.
    """
    cols = [F.lit(1.0)] + [F.col(x) for x in xs] + [F.col(y)]
    pairs = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    complete = df.dropna(subset=[y, *xs])
    return complete.groupBy(*keys).agg(F.array(*pairs).alias("gram"), F.count(F.lit(1)).alias("n"))


def unpack(flat: np.ndarray, k: int) -> np.ndarray:
    """Upper triangles, row by row, to symmetric matrices."""
    full = np.zeros((*flat.shape[:-1], k, k))
    i, j = np.triu_indices(k)
    full[..., i, j] = full[..., j, i] = flat
    return full


def solve_gram(grams: pd.Series, use: pd.Series, k: int) -> pd.DataFrame:
    """Coefficients (intercept first) and residual sum of squares of y on a subset of the columns.

    Rows that use the same columns are solved together; dependent columns get the solution of least norm.
    """
    beta, sse = [None] * len(grams), np.zeros(len(grams))
    alike: dict[tuple, list[int]] = {}
    for at, cols in enumerate(use):
        alike.setdefault((0, *map(int, cols)), []).append(at)
    flat = np.stack(grams.to_numpy()).astype(float) if len(grams) else np.empty((0, k * (k + 1) // 2))
    m = unpack(flat, k)
    for pick, rows in alike.items():
        inner, side = m[np.ix_(rows, pick, pick)], m[np.ix_(rows, pick, [k - 1])][:, :, 0]
        scale = np.sqrt(np.maximum(np.diagonal(inner, axis1=1, axis2=2), 1e-300))
        inverse = np.linalg.pinv(inner / (scale[:, :, None] * scale[:, None, :]), rcond=1e-12, hermitian=True)
        found = np.einsum("sij,sj->si", inverse, side / scale) / scale
        sse[rows] = np.maximum(m[rows, k - 1, k - 1] - (found * side).sum(axis=1), 0.0)
        for at, one in zip(rows, found):
            beta[at] = one
    return pd.DataFrame({"beta": beta, "sse": sse})


def solver(k: int):
    """Pandas UDF (gram, column subset) → struct(beta, sse); k counts the intercept and y."""

    def solve(grams: pd.Series, use: pd.Series) -> pd.DataFrame:
        return solve_gram(grams, use, k)

    solve.__annotations__ = {"grams": pd.Series, "use": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(solve, "beta array<double>, sse double")


def grouped_ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ID) -> DataFrame:
    """Ordinary least squares per group: beta (intercept first), sse, n."""
    g = gram(df, y, xs, keys)
    fit = solver(len(xs) + 2)(F.col("gram"), F.array(*[F.lit(i + 1) for i in range(len(xs))]))
    return g.withColumn("_f", fit).select(*keys, F.col("_f.beta").alias("beta"), F.col("_f.sse").alias("sse"), "n")


def decompose(panel: DataFrame, keys: Sequence[str] = ID, period: str = "m") -> DataFrame:
    """Additive decomposition with a per-series period column: trend, seasonal, remainder.

    The trend is a centred moving average (half weights at the ends for an even period), read off
    running sums, so its cost does not depend on the period.
    """
    w = over(keys)
    rows = panel.where(F.col("y").isNotNull()).select(
        *keys, "pos", "y", F.col(period).cast("int").alias("m"), F.sum("y").over(w).alias("cs")
    )
    packed = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "y", "cs"))).alias("_s"), F.max("m").alias("m"), F.count("y").cast("int").alias("n")
    ).withColumn("half", F.floor(F.col("m") / 2).cast("int"))
    flat = packed.select(*keys, "m", "n", "half", "_s", F.posexplode("_s").alias("i", "_r"))
    cs = lambda k: F.when(k < 0, 0.0).otherwise(F.get("_s", F.greatest(k, F.lit(0)))["cs"])
    block = lambda a, b: cs(b) - cs(a - 1)
    i, half = F.col("i"), F.col("half")
    odd = block(i - half, i + half)
    even = 0.5 * (block(i - half, i + half - 1) + block(i - half + 1, i + half))
    inside = (i >= half) & (i + half <= F.col("n") - 1) & (F.col("n") >= 2 * F.col("m"))
    out = flat.select(
        *keys, F.col("_r.pos").alias("pos"), F.col("_r.y").alias("y"), "m", "n", (i % F.col("m")).alias("phase"),
        F.when(inside, F.when(F.col("m") % 2 == 1, odd).otherwise(even) / F.col("m")).alias("trend"),
    )
    by_phase = whole([*keys, "phase"])
    out = out.select(
        "*", F.avg(F.col("y") - F.col("trend")).over(by_phase).alias("_a"),
        F.when(F.row_number().over(by_phase.orderBy("pos")) == 1, 1).alias("_first"),
    )
    centre = F.avg(F.when(F.col("_first") == 1, F.col("_a"))).over(whole(keys))
    out = out.withColumn("seasonal", F.col("_a") - centre)
    return out.select(*keys, "pos", "y", "m", "n", "phase", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("remainder"))
