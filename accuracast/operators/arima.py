"""Autoregressive moving-average models of a whole panel by two regression passes.

The estimator is Hannan-Rissanen (1982): a long autoregression gives residuals, a second regression
on lagged values and lagged residuals gives the model. Both are grouped least squares, so fitting
is two aggregations over the panel; all candidate orders share the cross products of the second
pass. It estimates the same model class as exact maximum likelihood, not the same numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.functions import columns as c
from accuracast.functions.columns import ID, over
from accuracast.operators import features as ft
from accuracast.operators.forecasters import Z95, assemble, fc_meanfill, steps
from accuracast.operators.linear import decompose, gram, solver
from accuracast.registry import register_model
from accuracast.session import written

MAX_D = 2
ALPHA = 0.05
MIN_INFORMATIVE = 10
LONG_EXTRA = 4


def lag_difference(arr: Column, lag: Column) -> Column:
    return F.zip_with(c.tail(arr, lag), c.head(arr, lag), lambda a, b: a - b)


def differenced(arrays: DataFrame, d: Column, D: Column, m: Column, most: int = MAX_D) -> DataFrame:
    """Difference ``ys`` D times at lag m and d times at lag 1, counts read from columns."""
    out = arrays.withColumns({"_d": d, "_ds": D, "_m": m})
    for i in range(1, most + 1):
        out = out.withColumn("ys", F.when(F.col("_ds") >= i, lag_difference(F.col("ys"), F.col("_m"))).otherwise(F.col("ys")))
    for i in range(1, most + 1):
        out = out.withColumn("ys", F.when(F.col("_d") >= i, c.first_diff(F.col("ys"))).otherwise(F.col("ys")))
    return restated(out.drop("_d", "_ds", "_m"))


def restated(arrays: DataFrame) -> DataFrame:
    """Recompute n, mu, sd, lo, hi after ``ys`` changed."""
    a = arrays.withColumn("n", F.size("ys").cast("bigint")).withColumn("mu", c.mean(F.col("ys")))
    dev = F.zip_with("ys", F.array_repeat("mu", F.size("ys")), lambda v, m: (v - m) * (v - m))
    return a.withColumns({"sd": F.when(F.col("n") > 1, F.sqrt(c.total(dev) / (F.col("n") - 1))), "lo": F.array_min("ys"), "hi": F.array_max("ys")})


def with_stationarity(arrays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``stationary``: unit root rejected and level stationarity not rejected."""
    a = ft.kpss_test(ft.adf_test(arrays, keys, least=10), keys, least=10)
    return a.withColumn("stationary", (F.col("n") >= 10) & (F.col("lo") < F.col("hi")) & (F.coalesce("adf_p", F.lit(0.0)) < ALPHA) & (F.coalesce("kpss_p", F.lit(1.0)) > ALPHA))


def estimate_d(past: DataFrame, keys: Sequence[str] = ID, max_d: int = MAX_D) -> DataFrame:
    """Smallest number of differences that makes a series stationary, as rows (keys, d)."""
    a = c.series_arrays(past, keys)
    zero = (F.col("n") < 10) | (F.col("lo") >= F.col("hi")) | (F.size(F.filter("ys", lambda v: v != 0)) < MIN_INFORMATIVE)
    a = a.withColumn("skip", zero).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(max_d))))
    tested = with_stationarity(differenced(a, F.col("d"), F.lit(0), F.lit(1), max_d), keys)
    return tested.groupBy(*keys).agg(
        F.when(F.bool_or("skip"), 0).otherwise(F.coalesce(F.min(F.when(F.col("stationary"), F.col("d"))), F.lit(max_d))).cast("int").alias("d")
    )


def acf_at(arrays: DataFrame, m: Column) -> DataFrame:
    """Adds ``acf_m``: biased autocorrelation at lag m, NULL when undefined."""
    a = c.with_deviations(arrays)
    ss = c.dot(F.col("es"), F.col("es"))
    return a.withColumn("acf_m", F.when((F.col("n") > m) & (F.col("lo") < F.col("hi")), c.lag_dot(F.col("es"), m) / ss)).drop("es")


def estimate_D(past: DataFrame, m: int, keys: Sequence[str] = ID, max_D: int = 1) -> DataFrame:
    """Smallest number of seasonal differences with a low seasonal autocorrelation and stationarity."""
    base = acf_at(c.series_arrays(past, keys), F.lit(m))
    zero = (F.lit(m) <= 1) | (F.col("n") < max(2 * m, 10)) | (F.col("lo") >= F.col("hi"))
    a = base.withColumn("skip", zero).withColumn("base", F.abs(F.coalesce("acf_m", F.lit(1.0)))).drop("acf_m")
    a = a.withColumn("ds", F.explode(F.sequence(F.lit(0), F.lit(max_D))))
    tested = with_stationarity(acf_at(differenced(a, F.lit(0), F.col("ds"), F.lit(m), max_D), F.lit(m)), keys)
    size = F.abs(F.coalesce("acf_m", F.lit(1.0)))
    ok = ((size <= 0.3) | (size <= 0.6 * F.col("base"))) & F.col("stationary")
    return tested.groupBy(*keys).agg(F.when(F.bool_or("skip"), 0).otherwise(F.coalesce(F.min(F.when(ok, F.col("ds"))), F.lit(max_D))).cast("int").alias("ds"))


def has_seasonality(past: DataFrame, m: int, keys: Sequence[str] = ID, strength: float = 0.9) -> DataFrame:
    """(keys, acf_m, strength, seasonal): significant autocorrelation at m, or a strong season."""
    a = acf_at(c.series_arrays(past, keys), F.lit(m)).select(*keys, "n", "acf_m")
    parts = decompose(past.select(*keys, "pos", "y", F.lit(m).alias("m")), keys).where(F.col("trend").isNotNull())
    total = F.var_samp(F.col("seasonal") + F.col("remainder"))
    s = parts.groupBy(*keys).agg(F.when(total > 0, F.greatest(F.lit(0.0), 1 - F.var_samp("remainder") / total)).alias("strength"))
    ok = (F.abs("acf_m") > 1.96 / F.sqrt("n")) | (F.col("strength") >= strength)
    enough = (F.lit(m) > 1) & (F.col("n") >= max(8, 2 * m))
    return a.join(s, list(keys), "left").select(*keys, "acf_m", "strength", F.when(enough, F.coalesce(ok, F.lit(False))).otherwise(False).alias("seasonal"))


def polynomials_udf():
    """(lags, coefs, kinds, d, ds, m) → dense autoregressive weights on the original scale and
    dense moving-average weights; index 0 is lag 1."""

    def run(lags: pd.Series, coefs: pd.Series, kinds: pd.Series, d: pd.Series, ds: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for ls, bs, ks, di, Di, mi in zip(lags, coefs, kinds, d, ds, m):
            phi, theta = np.zeros(1 + max([0, *[int(x) for x in ls]])), np.zeros(1 + max([0, *[int(x) for x in ls]]))
            phi[0] = 1.0
            for lag, b, kind in zip(ls, bs, ks):
                if kind == 0:
                    phi[int(lag)] -= b
                else:
                    theta[int(lag)] += b
            for _ in range(int(di)):
                phi = np.convolve(phi, [1.0, -1.0])
            season = np.zeros(int(mi) + 1)
            season[0], season[-1] = 1.0, -1.0
            for _ in range(int(Di)):
                phi = np.convolve(phi, season)
            ma = np.trim_zeros(theta[1:], "b")
            out.append(((-phi[1:]).tolist(), ma.tolist()))
        return pd.DataFrame(out, columns=["ar", "ma"])

    kinds = {k: pd.Series for k in ["lags", "coefs", "kinds", "d", "ds", "m"]}
    run.__annotations__ = {**kinds, "return": pd.DataFrame}
    return F.pandas_udf(run, "ar array<double>, ma array<double>")


def regress(past: DataFrame, orders: DataFrame, max_order: tuple[int, int, int, int], m: int, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, list]:
    """Second-stage rows, their cross products, and the regressor list [(lag, kind)].

    ``orders`` holds d and ds (seasonal differences) per series; kind 0 is a lagged value, 1 a lagged residual.
    """
    p, q, P, Q = max_order
    arrays = c.series_arrays(past, keys).join(orders.select(*keys, "d", "ds"), list(keys))
    w = differenced(arrays, F.col("d"), F.col("ds"), F.lit(max(m, 1)))
    rows = w.select(*keys, "d", "ds", F.posexplode("ys").alias("i", "w"))
    ar_lags = list(range(1, p + 1)) + [m * k for k in range(1, P + 1)]
    ma_lags = list(range(1, q + 1)) + [m * k for k in range(1, Q + 1)]
    win = over(keys, "i")
    if ma_lags:
        long = sorted(set(range(1, max(p, q) + LONG_EXTRA + 1)) | set(ar_lags) | set(ma_lags))
        names = [f"v{k}" for k in long]
        rows = rows.select("*", *[F.lag("w", k).over(win).alias(f"v{k}") for k in long])
        cross = gram(rows, "w", names, keys).where(F.col("n") > len(long) + 2)
        fit = cross.select(*keys, solver(len(long) + 2)(F.col("gram"), F.array(*[F.lit(j + 1) for j in range(len(long))])).alias("_f"))
        rows = rows.join(fit.select(*keys, F.col("_f.beta").alias("_b")), list(keys))
        guess = sum((F.get("_b", F.lit(j + 1)) * F.col(v) for j, v in enumerate(names)), F.get("_b", F.lit(0)))
        rows = rows.withColumn("e", F.col("w") - guess)
    else:
        rows = rows.withColumn("e", F.lit(0.0))
    xs = [(k, 0) for k in ar_lags] + [(k, 1) for k in ma_lags]
    rows = rows.select(*keys, "d", "ds", "i", "w", *[F.lag("w" if kind == 0 else "e", k).over(win).alias(f"x{kind}_{k}") for k, kind in xs])
    return rows, gram(rows, "w", [f"x{kind}_{k}" for k, kind in xs], keys), xs


def candidate_orders(p: Sequence[int], q: Sequence[int], P: Sequence[int], Q: Sequence[int], max_order) -> list[tuple]:
    """(p, q, P, Q, regressor positions) with positions counted from 1 after the intercept."""
    mp, mq, mP, _ = max_order
    out = []
    for a, b, s, t in itertools.product(p, q, P, Q):
        use = [i for i in range(1, a + 1)] + [mp + i for i in range(1, s + 1)]
        use += [mp + mP + i for i in range(1, b + 1)] + [mp + mP + mq + i for i in range(1, t + 1)]
        out.append((a, b, s, t, use))
    return out


# Weight of one parameter in each information criterion, as SQL over n.
CRITERIA = {"aic": "2e0", "bic": "ln(n)", "hqic": "2e0 * ln(ln(n))"}


def fit_orders(past: DataFrame, orders: DataFrame, candidates: Sequence[tuple], max_order, m: int, keys: Sequence[str], criterion: str = "aic"):
    """Best candidate per series: coefficients, variance, and the second-stage rows."""
    rows, cross, xs = regress(past, orders, max_order, m, keys)
    table = F.array(*[
        F.struct(F.lit(a).alias("p"), F.lit(b).alias("q"), F.lit(s).alias("ps"), F.lit(t).alias("qs"), F.array(*[F.lit(u) for u in use]).cast("array<int>").alias("use"))
        for a, b, s, t, use in candidates
    ])
    grid = cross.select(*keys, "gram", "n", F.explode(table).alias("o"))
    grid = grid.where(F.col("n") > F.size("o.use") + 2)
    fitted = grid.withColumn("_f", solver(len(xs) + 2)(F.col("gram"), F.col("o.use")))
    ic = F.col("n") * F.log(F.greatest(F.col("_f.sse"), F.lit(1e-300)) / F.col("n")) + F.expr(CRITERIA[criterion]) * (F.size("o.use") + 2)
    fitted = fitted.withColumn("ic", ic)
    best = fitted.groupBy(*keys).agg(F.min_by(
        F.struct("o", F.col("_f.beta").alias("beta"), F.col("_f.sse").alias("sse"), "n", "ic"),
        F.struct("ic", F.col("o.p").alias("p"), F.col("o.q").alias("q"), F.col("o.ps").alias("ps"), F.col("o.qs").alias("qs")),
    ).alias("b"))
    best = best.select(*keys, "b.o.p", "b.o.q", "b.o.ps", "b.o.qs", "b.o.use", "b.beta", "b.sse", "b.n", "b.ic")
    sigma2 = F.col("sse") / F.greatest(F.col("n") - F.size("beta"), F.lit(1))
    return rows, best.withColumn("sigma2", sigma2).join(orders.select(*keys, "d", "ds"), list(keys)), xs


def forecast_orders(past: DataFrame, rows: DataFrame, best: DataFrame, xs: list, h: int, m: int, model: str, step: str | None, keys: Sequence[str]) -> DataFrame:
    """Forecast table of fitted orders: recursion for the mean, psi weights for the bounds."""
    lag_of = F.array(*[F.lit(k) for k, _ in xs]).cast("array<int>")
    kind_of = F.array(*[F.lit(kind) for _, kind in xs]).cast("array<int>")
    b = best.withColumns({
        "lags": F.transform("use", lambda u: F.get(lag_of, u - 1)), "kinds": F.transform("use", lambda u: F.get(kind_of, u - 1)),
        "coefs": c.tail(F.col("beta"), F.lit(1)), "const": F.get("beta", F.lit(0)),
    })
    b = b.withColumn("_p", polynomials_udf()("lags", "coefs", "kinds", "d", "ds", F.lit(max(m, 1)))).select("*", "_p.ar", "_p.ma").drop("_p")
    # in-sample: fitted value = actual less the second-stage residual
    terms = [F.coalesce(F.get("beta", F.array_position("use", j + 1).cast("int")), F.lit(0.0)) * F.col(f"x{kind}_{k}") for j, (k, kind) in enumerate(xs)]
    used = [F.when(F.array_contains("use", j + 1), t).otherwise(0.0) for j, t in enumerate(terms)]
    resid = rows.join(b.select(*keys, "use", "beta", "const", "sigma2"), list(keys)).select(
        *keys, (F.col("i") + F.col("d") + m * F.col("ds")).alias("_i"), "sigma2", (F.col("w") - sum(used, F.col("const"))).alias("res")
    ).where(F.col("res").isNotNull())
    index = past.where(F.col("y").isNotNull()).withColumn("_i", (F.row_number().over(over(keys)) - 1).cast("bigint"))
    band = Z95 * F.sqrt("sigma2")
    history = index.join(resid, [*keys, "_i"]).select(*keys, "pos", "ts", "y", (F.col("y") - F.col("res")).alias("fit")
        , (F.col("y") - F.col("res") - band).alias("fit_lower"), (F.col("y") - F.col("res") + band).alias("fit_upper"))
    # newest-first tails of values and residuals
    need = max([k for k, _ in xs] or [0]) + MAX_D + m * MAX_D + 1
    recent = index.join(resid.select(*keys, "_i", "res"), [*keys, "_i"], "left").withColumn("_back", F.row_number().over(c.whole(keys).orderBy(F.col("_i").desc())))
    tails = recent.where(F.col("_back") <= need).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_back", "y", F.coalesce("res", F.lit(0.0)).alias("res")))).alias("_t"), F.max("pos").alias("_last")
    ).select(*keys, "_last", c.pluck(F.col("_t"), "y").alias("yr"), c.pluck(F.col("_t"), "res").alias("er"))
    f = b.join(tails, list(keys)).where((F.size("ar") <= F.size("yr")) & (F.size("ma") <= F.size("er")))
    na, nm = F.size("ar"), F.size("ma")

    def nxt(acc, _k):
        value = F.col("const") + c.dot(F.col("ar"), F.slice(acc["y"], F.lit(1), na)) + c.dot(F.col("ma"), F.slice(acc["e"], F.lit(1), nm))
        return F.struct(F.concat(F.array(value), acc["y"]).alias("y"), F.concat(F.array(F.lit(0.0)), acc["e"]).alias("e"))

    ahead = F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.struct(F.col("yr").alias("y"), F.col("er").alias("e")), nxt, lambda acc: F.reverse(F.slice(acc["y"], 1, h)))
    padded = F.concat("ar", F.array_repeat(F.lit(0.0), h))
    psi = F.aggregate(
        F.sequence(F.lit(1), F.lit(h - 1)) if h > 1 else F.array().cast("array<int>"), F.array(F.lit(1.0)),
        lambda acc, k: F.concat(F.array(c.dot(F.slice(padded, F.lit(1), k), acc) + F.coalesce(F.get("ma", k - 1), F.lit(0.0))), acc), F.reverse,
    )
    f = f.withColumns({"path": ahead, "psi2": F.transform(psi, lambda v: v * v)})
    future = f.select(*keys, "sigma2", "psi2", "_last", F.posexplode("path").alias("_k", "mean"))
    half = Z95 * F.sqrt(F.col("sigma2") * c.total(F.slice("psi2", F.lit(1), F.col("_k") + 1)))
    future = future.select(*keys, (F.col("_k") + 1).alias("k"), (F.col("_last") + F.col("_k") + 1).alias("pos"), "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))
    return assemble(history, future, model, h, step, keys)


@register_model("arima")
def fc_arima(past: DataFrame, h: int, keys: Sequence[str] = ID, step: str | None = None, order: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    p, d, q = order
    top = (p, q, 0, 0)
    orders = past.select(*keys).distinct().withColumns({"d": F.lit(d), "ds": F.lit(0)})
    rows, best, xs = fit_orders(past, orders, candidate_orders([p], [q], [0], [0], top), top, 0, keys)
    return forecast_orders(past, rows, best, xs, h, 0, f"ARIMA(p,d,q)={(p, d, q)}", step, keys)


@register_model("sarima")
def fc_sarima(past: DataFrame, h: int, keys: Sequence[str] = ID, step: str | None = None, order=(1, 1, 1), seasonal_order=(1, 1, 1, 12)) -> DataFrame:
    (p, d, q), (P, D, Q, m) = order, seasonal_order
    if m <= 1:
        return fc_arima(past, h, keys, step, order)
    top = (p, q, P, Q)
    orders = past.select(*keys).distinct().withColumns({"d": F.lit(d), "ds": F.lit(D)})
    rows, best, xs = fit_orders(past, orders, candidate_orders([p], [q], [P], [Q], top), top, m, keys)
    return forecast_orders(past, rows, best, xs, h, m, f"SARIMA(p,d,q)={(p, d, q)},(P,D,Q,m)={(P, D, Q, m)}", step, keys)


def choose_orders(past: DataFrame, m: int, seasonal: bool, max_d: int, max_D: int, keys: Sequence[str]) -> DataFrame:
    """(keys, seasonal, d, ds) per series."""
    d = estimate_d(past, keys, max_d)
    if not seasonal or m <= 1:
        return d.withColumns({"seasonal": F.lit(False), "ds": F.lit(0)})
    s = has_seasonality(past, m, keys).select(*keys, "seasonal")
    D = estimate_D(past, m, keys, max_D)
    return d.join(s, list(keys)).join(D, list(keys)).withColumn("ds", F.when(F.col("seasonal"), F.col("ds")).otherwise(0))


@register_model("auto_arima")
def fc_auto_arima(
    past: DataFrame, h: int, keys: Sequence[str] = ID, step: str | None = None, seasonal: bool = True, m: int = 52,
    max_p: int = 5, max_d: int = 2, max_q: int = 5, max_P: int = 2, max_D: int = 2, max_Q: int = 2, information_criterion: str = "aic",
) -> DataFrame:
    """Orders by stationarity tests and an information criterion over all candidate orders.

    Series that sum to zero, or that no candidate fits, get the mean forecast.
    """
    live = past.join(past.groupBy(*keys).agg(F.sum("y").alias("_s")).where("_s != 0").select(*keys), list(keys), "left_semi")
    # a row per series, read by every later step: store it instead of carrying its plan along
    orders = written(choose_orders(live, m, seasonal, max_d, max_D, keys), "orders")
    parts = []
    for flag, top, period in [(False, (max_p, max_q, 0, 0), 0), (True, (max_p, max_q, max_P, max_Q), m)]:
        if flag and (not seasonal or m <= 1):
            continue
        mine = orders.where(F.col("seasonal") == flag)
        if mine.isEmpty():
            continue
        some = live.join(mine.select(*keys), list(keys), "left_semi")
        grid = candidate_orders(range(top[0] + 1), range(top[1] + 1), range(top[2] + 1), range(top[3] + 1), top)
        rows, best, xs = fit_orders(some, mine, grid, top, period, keys, information_criterion)
        best = written(best, "orders")
        parts.append(written(forecast_orders(some, rows, best, xs, h, period, "AUTOARIMA", step, keys), "forecast"))
    if not parts:
        return fc_meanfill(past, h, keys, step)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    done = out.where(F.col("mean").isNotNull()).select(*keys).distinct()
    return out.unionByName(fc_meanfill(past.join(done, list(keys), "left_anti"), h, keys, step))
