"""Statistical features of each series: one shared pass for aggregates, short pipelines for the rest."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.functions import columns as c
from accuracast.functions.calendar import periods_per_year
from accuracast.functions.columns import ID, over, whole
from accuracast.functions.stats import adf_p_sql, chi2_tail, kpss_p_sql, normal_two_sided
from accuracast.operators.cleaning import infer_frequency
from accuracast.operators.linear import decompose
from accuracast.registry import FEATURES, register_feature, register_frame_feature

STUDY, META = ("study",), ("meta_learning",)
BOTH = ("study", "meta_learning")
ENTROPY_ORDER = 4
DEFAULT_PERIOD, MAX_PERIOD_LAG, PERIOD_ACF = 12, 60, 0.25


# ---- aggregates over prepared rows --------------------------------------------------------------


def prepared(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Rows with index, moments, lags and differences of their series; one shuffle and one sort."""
    w, g = over(keys), whole(keys)
    clean = panel.where(F.col("y").isNotNull()).select(*keys, "pos", "y")
    lags = [F.lag("y", k).over(w).alias(f"l{k}") for k in range(1, 6)]
    rows = clean.select(
        "*", *lags, (F.row_number().over(w).cast("bigint") - 1).alias("i"), F.count("y").over(g).alias("n"),
        F.avg("y").over(g).alias("mu"), F.coalesce(F.stddev_samp("y").over(g), F.lit(0.0)).alias("sd"), F.median("y").over(g).alias("med"),
    )
    above = (F.col("y") > F.col("med")).cast("int")
    return rows.select(
        "*", (F.col("y") - F.col("l1")).alias("d"), (F.col("l1") - F.col("l2")).alias("d1"),
        F.abs(above - (F.col("l1") > F.col("med")).cast("int")).alias("cross"),
    )


def enough(n: int, value: Column) -> Column:
    return F.when(F.count("y") >= n, value)


def lag_corr(k: int) -> Column:
    return c.corr("y", f"l{k}")


@register_feature("coefficient_of_variation", STUDY)
def _():
    return F.when(F.abs(F.avg("y")) >= 1e-12, F.coalesce(F.stddev_samp("y"), F.lit(0.0)) / F.abs(F.avg("y")))


@register_feature("kurtosis", BOTH)
def _():
    n = F.count("y")
    value = F.when(c.varies("y"), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("y") + 6)).otherwise(0.0)
    return enough(4, value)


@register_feature("ratio_zeros", STUDY)
def _():
    return F.avg((F.col("y") == 0).cast("double"))


@register_feature("runs_ratio_sign_changes", default=False)
def _():
    return F.coalesce(F.avg((F.signum("y") != F.signum("l1")).cast("double")), F.lit(0.0))


@register_feature("acf_lag1", META)
def _():
    return enough(2, lag_corr(1))


@register_feature("series_length", META, static=True)
def _():
    return F.count("y").cast("double")


@register_feature("full_series_mean", META, static=True)
def _():
    return F.avg("y")


@register_feature("full_series_std", META, static=True)
def _():
    return F.stddev_samp("y")


@register_feature("skewness", META)
def _():
    n = F.count("y")
    return enough(3, F.when(c.varies("y"), F.skewness("y") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0))


@register_feature("diff_acf_lag1", META)
def _():
    return enough(3, c.corr("d", "d1"))


@register_feature("acf_lag5_squared", META)
def _():
    return enough(6, sum((lag_corr(k) * lag_corr(k) for k in range(2, 6)), lag_corr(1) * lag_corr(1)))


def levinson(df: DataFrame, lags: int) -> DataFrame:
    """Adds the partial autocorrelations ``_f{k}_{k}`` to autocorrelations ``_r1`` .. ``_r{lags}`` of a row."""
    df = df.withColumn("_f1_1", F.col("_r1"))
    for k in range(2, lags + 1):
        num = F.col(f"_r{k}") - sum((F.col(f"_f{k - 1}_{j}") * F.col(f"_r{k - j}") for j in range(2, k)), F.col(f"_f{k - 1}_1") * F.col(f"_r{k - 1}"))
        den = 1 - sum((F.col(f"_f{k - 1}_{j}") * F.col(f"_r{j}") for j in range(2, k)), F.col(f"_f{k - 1}_1") * F.col("_r1"))
        df = df.withColumn(f"_f{k}_{k}", F.try_divide(num, den))
        df = df.withColumns({f"_f{k}_{j}": F.col(f"_f{k - 1}_{j}") - F.col(f"_f{k}_{k}") * F.col(f"_f{k - 1}_{k - j}") for j in range(1, k)})
    return df


@register_feature("pacf_lag5_squared", META)
def _():
    """Durbin-Levinson on the biased autocorrelations; one column per step keeps the plan flat."""
    e = F.col("y") - F.col("mu")
    var = F.sum(e * e)
    sums = {f"_r{k}": F.when(var > 0, F.sum(e * (F.col(f"l{k}") - F.col("mu"))) / var) for k in range(1, 6)}

    def finish(df: DataFrame) -> DataFrame:
        df = levinson(df, 5)
        value = sum((F.col(f"_f{k}_{k}") * F.col(f"_f{k}_{k}") for k in range(2, 6)), F.col("_f1_1") * F.col("_f1_1"))
        return df.withColumn("pacf_lag5_squared", F.when(F.col("_n") >= 6, value))

    return sums | {"_n": F.count("y")}, finish


@register_feature("spikiness", META)
def _():
    return enough(10, F.avg((F.abs(F.col("y") - F.col("mu")) > 2 * F.col("sd")).cast("double")))


@register_feature("linearity", META)
def _():
    return enough(3, F.when(c.varies("y"), F.regr_r2("y", "i")).otherwise(0.0))


@register_feature("crossing_points", META)
def _():
    return enough(3, F.sum("cross") / 2.0 / (F.count("y") - 1))


# ---- features that need more than one aggregation -----------------------------------------------


@register_frame_feature("weighted_permutation_entropy", BOTH)
def weighted_permutation_entropy(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Ordinal patterns of four values weighted by their variance, normalised entropy."""
    w, m = over(keys), ENTROPY_ORDER
    xs = ["y"] + [f"x{k}" for k in range(1, m)]
    clean = panel.where(F.col("y").isNotNull()).select(*keys, "pos", "y")
    rows = clean.select(*keys, "y", *[F.lead("y", k).over(w).alias(f"x{k}") for k in range(1, m)])
    mean = sum((F.col(x) for x in xs[1:]), F.col("y")) / m
    weight = sum(((F.col(x) - mean) * (F.col(x) - mean) for x in xs[1:]), (F.col("y") - mean) * (F.col("y") - mean)) / (m - 1)
    # ties go to the earlier value, so a pattern is fixed by its pairwise comparisons
    bits = [(F.col(xs[a]) <= F.col(xs[b])).cast("int") for a in range(m) for b in range(a + 1, m)]
    pattern = sum((b * (2 ** i) for i, b in enumerate(bits)), F.lit(0))
    per = rows.select(*keys, F.when(F.col(xs[-1]).isNotNull(), pattern).alias("p"), weight.alias("w")).groupBy(*keys, "p").agg(
        F.sum(F.when(F.col("p").isNotNull(), F.col("w")).otherwise(0.0)).alias("w")
    )
    total = F.sum("w")
    entropy = F.log(total) - F.sum(F.when(F.col("w") > 0, F.col("w") * F.log("w")).otherwise(0.0)) / total
    value = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy / math.log(math.factorial(m))))).otherwise(0.0)
    return per.groupBy(*keys).agg(value.alias("value"))


def rolling_statistics(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Stability and lumpiness: spread of rolling variances and means, window min(10, n/4)."""
    w, g = over(keys), whole(keys)
    clean = panel.where(F.col("y").isNotNull()).select(*keys, "pos", "y")
    rows = clean.select(*keys, F.count("y").over(g).alias("n"), F.array("y", *[F.lag("y", k).over(w) for k in range(1, 10)]).alias("a"))
    rows = rows.withColumn("w", F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("n") / 4).cast("int"))))
    rows = rows.withColumn("x", F.filter(F.slice("a", F.lit(1), F.col("w")), lambda v: v.isNotNull()))
    rows = rows.withColumn("k", F.size("x")).withColumn("mean", c.total(F.col("x")) / F.col("k"))
    rows = rows.withColumn("ss", F.aggregate("x", F.struct(F.lit(0.0).alias("s"), F.col("mean").alias("m")),
                           lambda acc, v: F.struct((acc["s"] + (v - acc["m"]) * (v - acc["m"])).alias("s"), acc["m"].alias("m")), lambda acc: acc["s"]))
    least = F.floor(F.col("w") / 2)
    rows = rows.select(
        *keys, "n",
        F.when((F.col("k") >= least) & (F.col("k") >= 2), F.col("ss") / (F.col("k") - 1)).alias("var"),
        F.when((F.col("k") >= least) & (F.col("k") >= 1), F.col("mean")).alias("avg"),
    )

    def spread(name):
        ratio = F.stddev_pop(name) / F.when(F.avg(name) != 0, F.avg(name))
        return F.when((F.max("n") >= 10) & (F.count(name) >= 2), ratio)

    return rows.groupBy(*keys).agg((1 / (1 + spread("var"))).alias("stability"), spread("avg").alias("lumpiness"))


@register_frame_feature("stability", META)
def _(panel, keys=ID):
    return rolling_statistics(panel, keys).select(*keys, F.col("stability").alias("value"))


@register_frame_feature("lumpiness", META)
def _(panel, keys=ID):
    return rolling_statistics(panel, keys).select(*keys, F.col("lumpiness").alias("value"))


@register_frame_feature("hurst_exponent", default=False)
def hurst_exponent(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Slope of log sd(y[t] - y[t-lag]) on log lag over 20 log-spaced lags from 10 to n/2."""
    arr = c.series_arrays(panel, keys).where("n >= 20")
    top = F.log10(F.floor(F.col("n") / 2).cast("double"))
    lags = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.floor(F.pow(F.lit(10.0), 1 + (top - 1) * i / 19) + 1e-9).cast("int")))
    rows = arr.select(*keys, "ys", F.explode(lags).alias("lag")).where("lag >= 2")
    diff = F.zip_with(c.tail(F.col("ys"), F.col("lag")), c.head(F.col("ys"), F.col("lag")), lambda a, b: a - b)
    sums = F.aggregate(diff, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
                       lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["q"] + v * v).alias("q")))
    rows = rows.select(*keys, "lag", (F.size("ys") - F.col("lag")).alias("k"), sums.alias("u")).where("k > 1")
    sd = F.sqrt(F.greatest((F.col("u.q") - F.col("u.s") * F.col("u.s") / F.col("k")) / (F.col("k") - 1), F.lit(0.0)))
    rows = rows.select(*keys, F.log("lag").alias("x"), F.log(F.greatest(sd, F.lit(1e-12))).alias("v"))
    slope = F.when(F.count("x") >= 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_slope("v", "x"))))
    return rows.groupBy(*keys).agg(slope.alias("value"))


def informative(extra: int = 20) -> Column:
    """Guard of the stationarity tests: long enough and not constant."""
    return (F.col("n") >= extra) & (F.col("lo") < F.col("hi"))


#: Share of the sum of squares below which a regression is taken to explain its target exactly.
EXACT_FIT = 1e-12


def explained(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Target parts along the columns, each freed of the columns before it: (s, rows, c), (s, rows) -> (s, c).

    Squares of the first j parts add up to what a least-squares fit on the first j columns explains, so
    one pass gives all nested fits of all series of a batch. A column that depends on earlier ones has no part.
    """
    q = np.zeros_like(x)
    for j in range(x.shape[2]):
        v = x[:, :, j]
        size = np.linalg.norm(v, axis=1)
        for _ in range(2):  # once more against rounding
            v = v - np.einsum("src,sc->sr", q[:, :, :j], np.einsum("src,sr->sc", q[:, :, :j], v))
        left = np.linalg.norm(v, axis=1)
        free = left > 1e-9 * size
        q[:, :, j] = np.where(free, 1.0 / np.where(free, left, 1.0), 0.0)[:, None] * v
    return np.einsum("src,sr->sc", q, y)


def _adf_equal(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and lag counts of series of one length, as rows of ``y``; none is constant."""
    z = (y - y.mean(axis=1, keepdims=True)) / y.std(axis=1, keepdims=True)
    dz = np.diff(z, axis=1)

    def columns(rows, skip, lags):
        level, past = z[rows, skip:-1], [dz[rows, skip - k : dz.shape[1] - k] for k in range(1, lags + 1)]
        return np.ones_like(level), level, past, dz[rows, skip:]

    everyone = np.arange(len(y))
    one, level, past, target = columns(everyone, most, most)
    total = (target**2).sum(axis=1, keepdims=True)
    sse = total - np.cumsum(explained(np.stack([one, level, *past], axis=2), target) ** 2, axis=1)[:, 1:]
    n = target.shape[1]
    aic = n * np.log(np.maximum(sse, np.maximum(EXACT_FIT * total, 1e-300)) / n) + 2 * np.arange(most + 1)
    best, stat = aic.argmin(axis=1), np.full(len(y), np.nan)
    for lags in np.unique(best).tolist():
        rows = everyone[best == lags]
        one, level, past, target = columns(rows, lags, lags)
        # the level comes last: its part over the residual deviation is its t value
        part = explained(np.stack([one, *past, level], axis=2), target)
        total = (target**2).sum(axis=1)
        sse = total - (part**2).sum(axis=1)
        fits = (sse > EXACT_FIT * total) & (part[:, -1] != 0)
        stat[rows[fits]] = part[fits, -1] / np.sqrt(sse[fits] / max(target.shape[1] - lags - 2, 1))
    return stat, best


def adf_statistic(series: pd.Series) -> pd.DataFrame:
    """Unit-root t statistic with constant, number of lags by AIC on the common sample.

    Series of one length are worked on together. Constant and very short series, and those their own
    past explains exactly, have no statistic.
    """
    arrays = [np.asarray(ys, dtype=float) for ys in series]
    out = pd.DataFrame({"stat": np.full(len(arrays), np.nan), "lags": pd.array([None] * len(arrays), dtype="Int32")})
    sizes = np.array([len(y) if len(y) and y.std() > 0 else 0 for y in arrays], int)
    for n in np.unique(sizes).tolist():
        most = min(n // 2 - 2, int(np.ceil(12.0 * (n / 100.0) ** 0.25)))
        if most < 0:
            continue
        found = np.flatnonzero(sizes == n)
        step = max(1, 2_000_000 // (n * (most + 3)))
        for at in (found[i : i + step] for i in range(0, len(found), step)):
            stat, lags = _adf_equal(np.stack([arrays[i] for i in at]), most)
            out.loc[at, "stat"], out.loc[at, "lags"] = stat, lags
    return out


def adf_udf():
    def run(ys: pd.Series) -> pd.DataFrame:
        return adf_statistic(ys)

    run.__annotations__ = {"ys": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "stat double, lags int")


def adf_test(arrays: DataFrame, keys: Sequence[str] = ID, least: int = 20) -> DataFrame:
    """Adds adf_stat and adf_p to series arrays; 1.0 for short or constant series."""
    out = arrays.withColumn("_a", adf_udf()("ys")).withColumn("adf_stat", F.when(informative(least), F.col("_a.stat")))
    return out.withColumn("adf_p", F.coalesce(F.expr(adf_p_sql("adf_stat")), F.lit(1.0))).drop("_a")


def kpss_test(arrays: DataFrame, keys: Sequence[str] = ID, least: int = 20) -> DataFrame:
    """Adds kpss_stat, kpss_lags and kpss_p; the lag count follows the data (Hobijn et al. 1998)."""
    a = c.with_deviations(arrays)
    n = F.greatest(F.col("n"), F.lit(1))  # differencing may leave nothing of a short series
    cov = F.transform(
        F.when(F.col("n") > 1, F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.pow(F.col("n").cast("double"), F.lit(2 / 9)) + 1e-9).cast("int")))).otherwise(F.array().cast("array<int>")),
        lambda k: c.lag_dot(F.col("es"), k) / (n / 2.0),
    )
    cum = F.aggregate("es", F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("q")),
                      lambda acc, e: F.struct((acc["c"] + e).alias("c"), (acc["q"] + (acc["c"] + e) * (acc["c"] + e)).alias("q")))
    a = a.select("*", c.dot(F.col("es"), F.col("es")).alias("_ss"), cov.alias("_cov"), cum["q"].alias("_eta"))
    s0 = F.col("_ss") / n + c.total(F.col("_cov"))
    s1 = F.aggregate("_cov", F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("i")),
                     lambda acc, v: F.struct((acc["s"] + v * acc["i"]).alias("s"), (acc["i"] + 1).alias("i")), lambda acc: acc["s"])
    gamma = 1.1447 * F.pow(F.try_divide(s1, s0) * F.try_divide(s1, s0), F.lit(1 / 3))
    lags = F.when(informative(least) & (s0 != 0), F.least(F.floor(gamma * F.pow(F.col("n").cast("double"), F.lit(1 / 3))), F.col("n") - 1).cast("int"))
    a = a.withColumn("kpss_lags", lags)
    weighted = F.aggregate(
        F.when(F.col("kpss_lags") > 0, F.sequence(F.lit(1), F.col("kpss_lags"))).otherwise(F.array().cast("array<int>")), F.lit(0.0),
        lambda acc, k: acc + (1 - k / (F.col("kpss_lags") + 1.0)) * c.lag_dot(F.col("es"), k),
    )
    scale = (F.col("_ss") + 2 * weighted) / n
    a = a.withColumn("kpss_stat", F.when(informative(least) & F.col("kpss_lags").isNotNull(), F.try_divide(F.col("_eta") / (n * n), scale)))
    return a.withColumn("kpss_p", F.coalesce(F.expr(kpss_p_sql("kpss_stat")), F.lit(1.0))).drop("_ss", "_cov", "_eta", "es")


@register_frame_feature("adf_pvalue", STUDY)
def _(panel, keys=ID):
    return adf_test(c.series_arrays(panel, keys), keys).select(*keys, F.col("adf_p").alias("value"))


@register_frame_feature("kpss_pvalue", STUDY)
def _(panel, keys=ID):
    return kpss_test(c.series_arrays(panel, keys), keys).select(*keys, F.col("kpss_p").alias("value"))


def ljung_box(arrays: DataFrame) -> DataFrame:
    """Adds lb_lags, lb_stat and lb_p of the values in ``ys``."""
    a = c.with_deviations(arrays)
    lags = F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.col("n") / 4).cast("int")))
    a = a.select("*", lags.alias("lb_lags"), c.dot(F.col("es"), F.col("es")).alias("_ss"))
    rho2 = F.transform(F.sequence(F.lit(1), F.col("lb_lags")), lambda k: F.pow(c.lag_dot(F.col("es"), k), F.lit(2.0)) / (F.col("n") - k))
    a = a.withColumn("_q", c.total(rho2))
    a = a.withColumn("lb_stat", F.when(F.col("_ss") > 0, F.col("n") * (F.col("n") + 2) * F.col("_q") / (F.col("_ss") * F.col("_ss"))))
    return a.withColumn("lb_p", F.when(F.col("lb_stat").isNotNull(), chi2_tail("lb_stat", "lb_lags"))).drop("_ss", "_q", "es")


@register_frame_feature("ljung_box_pvalue", default=False)
def _(panel, keys=ID):
    return ljung_box(c.series_arrays(panel, keys).where("n >= 5")).select(*keys, F.col("lb_p").alias("value"))


PAIR_POINTS = 262_144


def first_true(low: np.ndarray, high: np.ndarray, test) -> np.ndarray:
    """Per element the first k in low..high with test(k), ``high`` if there is none; test must be monotone in k."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        hit = test(np.minimum(mid, len(low) - 1)) & open_
        high, low = np.where(hit, mid, high), np.where(open_ & ~hit, mid + 1, low)
    return low


def count_in_boxes(q: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of q[left:right] lie in low..high-1, for every box at once: one radix level of q after the other."""
    total = np.zeros(len(left), dtype=np.int64)
    ends = [[left, right, high, 1], [left, right, low, -1]]
    for b in range(int(max(q.max(initial=0), high.max(initial=0))).bit_length() - 1, -1, -1):
        one = (q >> b) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~one)])
        for end in ends:
            i, j, bound, sign = end
            up, zi, zj = (bound >> b) & 1 == 1, zeros[i], zeros[j]
            total += sign * np.where(up, zj - zi, 0)
            end[0], end[1] = np.where(up, zeros[-1] + i - zi, zi), np.where(up, zeros[-1] + j - zj, zj)
        q = np.concatenate([q[~one], q[one]])
    return total


def close_pair_counts(y: np.ndarray, sizes: np.ndarray, eps: np.ndarray) -> np.ndarray:
    """Counts behind the correlation integrals of several series laid end to end, one row a series.

    Columns: close pairs, close pairs without the first point, close pairs whose successors are close, sum of
    squared and of plain numbers of close points. Points are ranked inside their series; what is close to a point is
    a range of ranks, found by bisection with the comparison itself, so ties at the distance fall as if all pairs
    were compared. Pairs of pairs are points in a box of two such ranges. n log n steps, memory in proportion to n.
    """
    row, n = np.repeat(np.arange(len(sizes)), sizes), int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((y, row))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    s, e, first, last = y[order], eps[row], begin[row], (begin + sizes)[row]
    low = first_true(first, rank, lambda k: y - s[k] < e)
    high = np.maximum(first_true(rank, last, lambda k: ~(s[k] - y < e)), low)
    near = high - low
    own = (near > 0).astype(np.int64)
    per = lambda w: np.bincount(row, weights=w, minlength=len(sizes))
    c1 = (per(near) - per(own)) / 2
    at = np.flatnonzero(np.arange(n) + 1 < last)  # points with a successor
    by_rank = at[np.argsort(rank[at], kind="stable")]
    held = np.concatenate([[0], np.cumsum(np.isin(order, at, assume_unique=True))])  # of the first k ranks, those in ``at``
    boxes = count_in_boxes(rank[by_rank + 1], held[low[at]], held[high[at]], low[at + 1], high[at + 1])
    both = np.bincount(row[at], weights=boxes - own[at] * own[np.minimum(at + 1, n - 1)], minlength=len(sizes)) / 2
    some = sizes > 0
    start = np.where(some, begin, 0)
    lead = np.where(some, near[start] - own[start], 0) if n else np.zeros(len(sizes))
    return np.column_stack([c1, c1 - lead, both, per(near.astype(float) ** 2), per(near)])


def close_pairs(values: pd.Series, eps: pd.Series) -> pd.DataFrame:
    """``close_pair_counts`` of a batch, some ``PAIR_POINTS`` points at a time."""
    arrays = [np.asarray(v, dtype=float) for v in values]
    sizes, e = np.array([len(a) for a in arrays], dtype=np.int64), eps.to_numpy(dtype=float)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIR_POINTS, prepend=0))
    out = [close_pair_counts(np.concatenate([arrays[i] for i in part]), sizes[part], e[part]) for part in np.split(np.arange(len(arrays)), cut) if len(part)]
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 5)), columns=["c1", "c1_inner", "c2", "sq", "rows"])


def close_pairs_udf():
    def run(values: pd.Series, eps: pd.Series) -> pd.DataFrame:
        return close_pairs(values, eps)

    run.__annotations__ = {"values": pd.Series, "eps": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "c1 double, c1_inner double, c2 double, sq double, rows double")


def bds_test(arrays: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Adds bds_stat and bds_p: embedding dimension 2, distance 1.5 sd; NULL below three values.

    Pairs are counted where the series already is, in n log n steps: no shuffle and no pair that becomes a row.
    """
    long = F.col("n") >= 3
    counted = arrays.withColumn("_k", close_pairs_udf()(F.when(long, F.col("ys")).otherwise(F.array().cast("array<double>")), F.coalesce(1.5 * F.col("sd"), F.lit(0.0))))
    n = F.when(long, F.col("n").cast("double"))
    counted = counted.withColumns({
        "_p1": 2 * F.col("_k.c1") / (n * (n - 1)), "_p1i": 2 * F.col("_k.c1_inner") / ((n - 1) * (n - 2)), "_p2": 2 * F.col("_k.c2") / ((n - 1) * (n - 2)),
        "_k3": (F.col("_k.sq") - 3 * F.col("_k.rows") + 2 * n) / (n * (n - 1) * (n - 2)),
    })
    sd = 2 * F.abs(F.col("_k3") - F.col("_p1") * F.col("_p1"))
    counted = counted.withColumn("bds_stat", F.when(sd > 1e-12, F.sqrt(n - 1) * (F.col("_p2") - F.col("_p1i") * F.col("_p1i")) / sd))
    counted = counted.withColumn("bds_p", F.when(F.col("bds_stat").isNotNull(), normal_two_sided("bds_stat")))
    return counted.drop("_k", "_p1", "_p1i", "_p2", "_k3")


@register_frame_feature("bds_pvalue", default=False)
def _(panel, keys=ID):
    return bds_test(c.series_arrays(panel, keys), keys).select(*keys, F.col("bds_p").alias("value"))


def autocorrelations(arrays: DataFrame, max_lag: int = MAX_PERIOD_LAG) -> DataFrame:
    """Adds ``acf``: biased autocorrelations at lag 1..min(max_lag, n/2)."""
    a = c.with_deviations(arrays)
    a = a.withColumn("_ss", c.dot(F.col("es"), F.col("es")))
    lags = F.least(F.lit(max_lag), F.floor(F.col("n") / 2).cast("int"))
    seq = F.when(lags >= 1, F.sequence(F.lit(1), lags)).otherwise(F.array().cast("array<int>"))
    return a.withColumn("acf", F.when(F.col("_ss") > 0, F.transform(seq, lambda k: c.lag_dot(F.col("es"), k) / F.col("_ss")))).drop("_ss", "es")


def infer_period(panel: DataFrame, keys: Sequence[str] = ID, by_index: bool = False, max_lag: int = MAX_PERIOD_LAG) -> DataFrame:
    """Season length per series: the highest local peak of the autocorrelation above 0.25, else 12.

    With ``by_index`` a series with a regular step of known frequency has its periods per year instead.
    Peaks are sought up to ``max_lag``.
    """
    a = autocorrelations(c.series_arrays(panel, keys), max_lag)
    # lag k sits at index k-1; a peak needs both neighbours
    peaks = F.filter(
        F.transform("acf", lambda v, i: F.struct(v.alias("v"), (-(i + 1)).alias("neg_lag"), F.get("acf", i - 1).alias("p"), F.get("acf", i + 1).alias("q"))),
        lambda s: (s["neg_lag"] <= -2) & (s["v"] > s["p"]) & (s["v"] > s["q"]),
    )
    a = a.select(*keys, "n", F.array_max(F.transform(peaks, lambda s: F.struct(s["v"].alias("v"), s["neg_lag"].alias("neg_lag")))).alias("best"))
    m = F.when(F.col("best.v") > PERIOD_ACF, -F.col("best.neg_lag")).otherwise(DEFAULT_PERIOD)
    found = a.select(*keys, m.cast("int").alias("m"))
    if not by_index:
        return found
    known = infer_frequency(panel, keys).select(*keys, periods_per_year(F.col("freq")).alias("_year"))
    return found.join(known, list(keys)).select(*keys, F.coalesce("_year", "m").alias("m"))


def strengths(panel: DataFrame, keys: Sequence[str] = ID, periods: DataFrame | None = None) -> DataFrame:
    """Trend and seasonal strength from the decomposition, with the short-series fallbacks."""
    periods = infer_period(panel, keys) if periods is None else periods
    rows = panel.where(F.col("y").isNotNull()).join(periods, list(keys)).select(*keys, "pos", "y", "m")
    parts = decompose(rows, keys)
    a = c.series_arrays(panel, keys).join(periods, list(keys))
    head, tail_ = c.head(F.col("ys"), F.col("m")), c.tail(F.col("ys"), F.col("m"))
    moments = lambda x: F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda s, v: F.struct((s["s"] + v).alias("s"), (s["q"] + v * v).alias("q")))
    a = a.select(*keys, "n", "m", moments(head).alias("h"), moments(tail_).alias("t"), c.dot(head, tail_).alias("ht"), F.when(F.col("n") > F.col("m"), F.col("n") - F.col("m")).alias("k"))
    den = (F.col("h.q") - F.col("h.s") * F.col("h.s") / F.col("k")) * (F.col("t.q") - F.col("t.s") * F.col("t.s") / F.col("k"))
    short = F.when((F.col("k") > 1) & (den > 0), F.abs((F.col("ht") - F.col("h.s") * F.col("t.s") / F.col("k")) / F.sqrt(den))).otherwise(0.0)
    index = F.row_number().over(over(keys)).cast("bigint")
    r2 = rows.select(*keys, "y", index.alias("i")).groupBy(*keys).agg(F.when(c.varies("y"), F.regr_r2("y", "i")).otherwise(0.0).alias("r2"))
    var_r = F.var_samp("remainder")
    tr, sr = F.col("trend") + F.col("remainder"), F.col("seasonal") + F.col("remainder")
    known = F.col("trend").isNotNull()
    strong = lambda v, all_: F.when(all_ < 1e-10, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - v / all_))
    s = parts.where(known).groupBy(*keys).agg(
        strong(F.var_pop("remainder"), F.var_pop(tr)).alias("_trend"), strong(var_r, F.var_samp(sr)).alias("_season")
    )
    out = a.select(*keys, "n", "m", short.alias("short")).join(r2, list(keys)).join(s, list(keys), "left")
    long = (F.col("m") > 1) & (F.col("n") >= 2 * F.col("m"))
    return out.select(
        *keys, "m",
        F.when(long, F.col("_trend")).when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), 1.5 * F.col("r2"))).alias("trend_strength"),
        F.when(long, F.col("_season")).otherwise(F.when(F.col("n") < 2 * F.col("m"), F.col("short")).otherwise(0.0)).alias("seasonal_strength"),
    )


@register_frame_feature("trend_strength", BOTH)
def _(panel, keys=ID):
    return strengths(panel, keys).select(*keys, F.col("trend_strength").alias("value"))


@register_frame_feature("seasonal_strength", BOTH)
def _(panel, keys=ID):
    return strengths(panel, keys).select(*keys, F.col("seasonal_strength").alias("value"))


# ---- all of them --------------------------------------------------------------------------------

SHARED = {
    ("stability", "lumpiness"): rolling_statistics,
    ("trend_strength", "seasonal_strength"): strengths,
}


def feature_names(group: str | None = None, static: bool | None = None, default_only: bool = True) -> list[str]:
    """Registered features of a group and static tag, in registration order."""
    return [
        f.name for f in FEATURES.values()
        if (group is None or group in f.groups) and (static is None or f.static == static) and (f.default or not default_only)
    ]


def features_wide(panel: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = ID) -> DataFrame:
    """One row per series, one column per feature. All series appear, a failed feature is NULL."""
    names = list(names) if names is not None else feature_names()
    known = [FEATURES[n] for n in names]
    aggregates = [f for f in known if f.build is not None]
    frames = [f for f in known if f.frame is not None]
    ids = panel.select(*keys).distinct()
    if aggregates:
        built = {f.name: f.build() for f in aggregates}
        helpers = {k: v for b in built.values() if isinstance(b, tuple) for k, v in b[0].items()}
        plain = {n: b for n, b in built.items() if not isinstance(b, tuple)}
        base = prepared(panel, keys).groupBy(*keys).agg(*[b.alias(n) for n, b in (plain | helpers).items()])
        for b in built.values():
            base = b[1](base) if isinstance(b, tuple) else base
        out = ids.join(base.select(*keys, *built), list(keys), "left")
    else:
        out = ids
    pending = [f.name for f in frames]
    for group, build in SHARED.items():
        wanted = [n for n in group if n in pending]
        if wanted:
            out = out.join(build(panel, keys).select(*keys, *wanted), list(keys), "left")
            pending = [n for n in pending if n not in wanted]
    for name in pending:
        out = out.join(FEATURES[name].frame(panel, keys).select(*keys, F.col("value").alias(name)), list(keys), "left")
    return out.select(*keys, *[c.finite(n).alias(n) for n in names])


def compute_features(panel: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = ID) -> DataFrame:
    """Long form: keys, feature, value."""
    names = list(names) if names is not None else feature_names()
    return features_wide(panel, names, keys).unpivot(list(keys), names, "feature", "value")


# Reading of each feature, first rule that holds wins.
INTERPRETATIONS = {
    "adf_pvalue": [("v < 0.05", "Unit root rejected (stationary)"), ("true", "Cannot reject unit root")],
    "kpss_pvalue": [("v < 0.05", "Stationarity rejected"), ("true", "Cannot reject stationarity")],
    "bds_pvalue": [("v > 0.05", "I.I.D. (no dependence detected)"), ("true", "Non-IID structure detected")],
    "coefficient_of_variation": [("v < 0.2", "Low dispersion"), ("v < 0.5", "Moderate dispersion"), ("true", "High dispersion")],
    "hurst_exponent": [("v < 0.45", "Mean-reverting"), ("v <= 0.55", "Random walk-like"), ("true", "Persistent (trending)")],
    "ljung_box_pvalue": [("v > 0.05", "No autocorrelation detected"), ("true", "Autocorrelation present")],
    "runs_ratio_sign_changes": [
        ("v < 0.10", "Very few sign changes (strong persistence)"), ("v < 0.40", "Few sign changes (possible trend)"),
        ("v <= 0.70", "Moderate sign changes"), ("true", "Many sign changes (noisy)"),
    ],
    "weighted_permutation_entropy": [("v < 0.3", "Low complexity (predictable)"), ("v < 0.7", "Moderate complexity"), ("true", "High complexity/random-like")],
    "trend_strength": [("v < 0.1", "No trend"), ("v < 0.4", "Weak trend"), ("v < 0.7", "Moderate trend"), ("true", "Strong trend")],
    "seasonal_strength": [("v < 0.1", "No seasonality"), ("v < 0.4", "Weak seasonality"), ("v < 0.7", "Moderate seasonality"), ("true", "Strong seasonality")],
    "acf_lag1": [("v < -0.5", "Negative autocorrelation"), ("abs(v) < 0.3", "Weak autocorrelation"), ("true", "Strong autocorrelation")],
    "series_length": [("v < 50", "Very short"), ("v < 100", "Short"), ("v < 200", "Medium"), ("true", "Long")],
    "skewness": [("v < -0.5", "Left-skewed"), ("abs(v) < 0.5", "Symmetric"), ("true", "Right-skewed")],
    "kurtosis": [("v < 0", "Light-tailed"), ("v < 3", "Normal"), ("true", "Heavy-tailed")],
    "diff_acf_lag1": [("v < -0.5", "Negative"), ("abs(v) < 0.3", "Weak"), ("true", "Strong")],
    "stability": [("v < 0.3", "Unstable"), ("v < 0.7", "Moderately stable"), ("true", "Very stable")],
    "lumpiness": [("v < 0.1", "Smooth"), ("v < 0.3", "Moderately lumpy"), ("true", "Very lumpy")],
    "acf_lag5_squared": [("v < 1.0", "Weak autocorrelation"), ("v < 2.0", "Moderate autocorrelation"), ("true", "Strong autocorrelation")],
    "pacf_lag5_squared": [("v < 1.0", "Weak partial autocorrelation"), ("v < 2.0", "Moderate partial autocorrelation"), ("true", "Strong partial autocorrelation")],
    "spikiness": [("v < 0.05", "Smooth"), ("v < 0.1", "Moderately spiky"), ("true", "Very spiky")],
    "linearity": [("v < 0.1", "No linear trend"), ("v < 0.4", "Weak linear trend"), ("v < 0.7", "Moderate linear trend"), ("true", "Strong linear trend")],
    "crossing_points": [("v < 0.1", "Very persistent"), ("v < 0.3", "Persistent"), ("v < 0.5", "Moderate oscillation"), ("true", "High oscillation")],
}
NO_RESULT = "No result (insufficient data)"


def interpretation_sql(round_fn: str = "bround", text: str = "string") -> str:
    """CASE over (feature, v) that reads a value in words."""
    branches = [f"WHEN v IS NULL THEN '{NO_RESULT}'"]
    branches += [f"WHEN feature = 'ratio_zeros' THEN concat(cast({round_fn}(v * 100e0, 4) as {text}), '% of zeros in time series')"]
    for name, rules in INTERPRETATIONS.items():
        branches += [f"WHEN feature = '{name}' AND {rule} THEN '{label}'" for rule, label in rules]
    return f"CASE {' '.join(branches)} END"


def interpret_features(features: DataFrame) -> DataFrame:
    """Add the reading of every value to long-form features."""
    return features.withColumn("v", F.col("value")).withColumn("interpretation", F.expr(interpretation_sql())).drop("v")


def features_by_group(features: DataFrame, group: str, static: bool | None = None) -> DataFrame:
    """Rows of long-form features that carry a group (and static tag)."""
    return features.where(F.col("feature").isin(feature_names(group, static)))
