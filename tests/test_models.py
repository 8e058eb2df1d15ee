"""Features, metrics and forecasters against numpy and hand-written cases."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accuracast.functions import columns as c
from accuracast.operators import arima as ar
from accuracast.operators import boosting as gb
from accuracast.operators import catalogue as ct
from accuracast.operators import features as ft
from accuracast.operators import forecasters as fc
from accuracast.operators import metrics as mt
from accuracast.operators import predictors as pr
from accuracast.operators.linear import grouped_ols

RNG = np.random.default_rng(3)


def test_constant_and_short_series(make):
    p = make({"const": [5] * 30, "zero": [0] * 30, "two": [1, 2], "one": [4]})
    d = ft.features_wide(p).toPandas().set_index("series_id")
    assert d.loc["const", "adf_pvalue"] == 1.0 and d.loc["const", "kpss_pvalue"] == 1.0 and d.loc["const", "spikiness"] == 0
    assert d.loc["const", "kurtosis"] == 0 and np.isnan(d.loc["const", "acf_lag1"]) and np.isnan(d.loc["zero", "coefficient_of_variation"])
    assert d.loc["zero", "ratio_zeros"] == 1 and d.loc["one", "coefficient_of_variation"] == 0
    assert np.isnan(d.loc["two", "skewness"]) and np.isnan(d.loc["two", "stability"]) and d.loc["two", "weighted_permutation_entropy"] == 0


def test_features_match_pandas(make):
    y = RNG.normal(10, 3, 80).cumsum().round(3)
    d = ft.features_wide(make({"a": y}), ["skewness", "kurtosis", "acf_lag1", "diff_acf_lag1", "full_series_std", "crossing_points"]).first()
    s = pd.Series(y)
    assert d.skewness == pytest.approx(s.skew()) and d.kurtosis == pytest.approx(s.kurtosis()) and d.acf_lag1 == pytest.approx(s.autocorr(1))
    assert d.diff_acf_lag1 == pytest.approx(s.diff().dropna().autocorr(1)) and d.full_series_std == pytest.approx(s.std())
    assert d.crossing_points == pytest.approx((s > s.median()).astype(int).diff().abs().sum() / 2 / 79)


def test_unit_root_statistic_separates():
    walk, noise = RNG.normal(size=300).cumsum(), RNG.normal(size=300)
    got = ft.adf_statistic(pd.Series([walk, noise, [1.0, 2.0]]))
    assert got.stat[1] < -10 < got.stat[0] and np.isnan(got.stat[2])


def plain_adf(y):
    n, z = len(y), (y - y.mean()) / y.std()
    dz, most = np.diff(z), min(n // 2 - 2, int(np.ceil(12 * (n / 100) ** 0.25)))

    def fit(skip, lags):
        x = np.column_stack([np.ones(len(dz) - skip), z[skip:-1]] + [dz[skip - k : len(dz) - k] for k in range(1, lags + 1)])
        beta = np.linalg.lstsq(x, dz[skip:], rcond=None)[0]
        return x, beta, ((dz[skip:] - x @ beta) ** 2).sum()

    best = min(range(most + 1), key=lambda k: (n - 1 - most) * np.log(fit(most, k)[2]) + 2 * k)
    x, beta, sse = fit(best, best)
    return beta[1] / np.sqrt(np.linalg.inv(x.T @ x)[1, 1] * sse / (len(x) - x.shape[1])), best


def test_unit_root_batches_equal_single_regressions():
    many = [RNG.normal(size=n).cumsum() * 10.0**k + 1e4 for n in (12, 60, 60, 61, 200) for k in (0, 5)]
    many += [np.convolve(RNG.normal(size=120), [1, 0.8, -0.6, 0.5], "valid") for _ in range(6)]
    got = ft.adf_statistic(pd.Series(many))
    want = [plain_adf(y) for y in many]
    assert got.lags.tolist() == [k for _, k in want] and got.stat.to_numpy() == pytest.approx([t for t, _ in want], rel=1e-7)
    odd = ft.adf_statistic(pd.Series([np.full(30, 2.0), np.arange(40.0), [], [1.0, 2.0, 4.0], np.tile([1.0, -1.0], 30)]))
    assert odd.stat.isna().all() and odd.lags.isna().tolist() == [True, False, True, True, False]


def test_bds_statistic(make):
    y = RNG.normal(size=70)
    arrays = c.series_arrays(make({"a": y, "b": y[:2]}))
    got = {r.series_id: r for r in ft.bds_test(arrays).collect()}
    n, eps = 70, 1.5 * y.std(ddof=1)
    near = np.abs(y[:, None] - y[None, :]) < eps
    up = lambda m: m[np.triu_indices(len(m), 1)].mean()
    k = ((near.sum(1) ** 2).sum() - 3 * near.sum() + 2 * n) / (n * (n - 1) * (n - 2))
    stat = np.sqrt(n - 1) * (up(near[1:, 1:] & near[:-1, :-1]) - up(near[1:, 1:]) ** 2) / (2 * abs(k - up(near) ** 2))
    assert got["a"].bds_stat == pytest.approx(stat) and got["b"].bds_stat is None


def all_pairs(y, e):
    """The five counts by comparing every point with every other, a block of points at a time."""
    n, c1, inner, c2, rows = len(y), 0, 0, 0, []
    for a in range(0, n, 1000):
        near = np.abs(y[a : a + 1001, None] - y[None, :]) < e
        here = near[:1000]
        after = np.arange(n)[None, :] > np.arange(a, a + len(here))[:, None]
        rows.append(here.sum(axis=1))
        c1, inner = c1 + (here & after).sum(), inner + (here & after)[1 if a == 0 else 0 :].sum()
        both = here[: len(near) - 1, :-1] & near[1 : len(here) + 1, 1:]
        c2 += (both & after[: len(both), :-1]).sum()
    r = np.concatenate(rows or [np.zeros(0)]).astype(float)
    return [c1, inner, c2, (r**2).sum(), r.sum()]


def test_pair_counts_equal_all_pairs():
    kinds = [lambda n: RNG.normal(size=n), lambda n: RNG.integers(0, 5, n).astype(float), lambda n: RNG.integers(0, 9, n) * 0.1, np.zeros]
    ys = [kinds[k % 4](int(RNG.integers(0, 40))) for k in range(300)] + [np.round(RNG.normal(size=5000), 1)]
    eps = [[0.3, 0.0, 0.1, 2.0, float("nan")][k % 5] for k in range(301)]
    got = ft.close_pairs(pd.Series(ys), pd.Series(eps)).to_numpy()
    assert np.array_equal(got, np.array([all_pairs(y, e) for y, e in zip(ys, eps)], dtype=float))
    assert len(ft.close_pairs(pd.Series([], dtype=object), pd.Series([], dtype=float))) == 0


def test_pair_counts_of_a_long_series():
    y = RNG.normal(size=50_000)
    tracemalloc.start()
    got = ft.close_pairs(pd.Series([y]), pd.Series([0.4])).iloc[0].tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    s = np.sort(y)
    rows = np.searchsorted(s, y + 0.4) - np.searchsorted(s, y - 0.4, side="right")
    assert got[4] == rows.sum() and got[3] == (rows.astype(float) ** 2).sum() and got[0] == (got[4] - 50_000) / 2


def test_bootstrap_of_units_equals_plain_resampling(spark):
    """Intervals do not depend on how replicates are dealt, and follow from the stated draws."""
    y, f = [3.0, 5.0, 4.0, 9.0, 7.0, 6.0], [4.0, 4.5, 5.0, 6.0, 6.5, 7.0]
    units = unit(spark, [1, 4, 2, 8, 5], y, f, [v - 1 for v in f], [v + 1 for v in f])
    got = {r.metric: (r.lower, r.upper) for r in pr.bootstrap_metrics(units, 60, metrics=["rpa", "mia"]).collect()}
    past = np.array([1.0, 4, 2, 8, 5])
    scale = np.median(np.abs(past - np.median(past)))

    def draw(b, i):
        x = (1 + b * 7919 + i * 104729) % 2**32
        for _ in range(2):
            x = (x ^ (x >> 16)) * 73244475 % 2**32
        return ((x ^ (x >> 16)) >> 8) % 6

    err = np.abs(np.array(y) - np.array(f))
    picks = [[draw(b, i) for i in range(6)] for b in range(60)]
    rpa = [1 - round(float(np.mean(err[p] / (err[p] + scale + 1e-12))), 4) for p in picks]
    mia = [1 - float(np.mean(err[p] > 1)) for p in picks]
    assert got["rpa"] == pytest.approx(tuple(np.quantile(rpa, [0.025, 0.975]))) and got["mia"] == pytest.approx(tuple(np.quantile(mia, [0.025, 0.975])))


def test_partial_autocorrelations_solve_yule_walker(make):
    y = [RNG.normal(size=60).cumsum(), RNG.normal(size=9), np.ones(20), np.array([2.0])]
    got = ct.feature_catalogue(make(dict(zip("abcd", y)))).where("feature like 'partial%'").toPandas()
    value = {(r.series_id, int(r.feature[-1])): r.value for r in got.itertuples()}
    assert len(value) == 20 and not any(np.isfinite(value[s, k]) for s in "cd" for k in range(1, 6))
    assert np.isfinite(value["b", 3]) and np.isnan(value["b", 4])  # below half of nine values
    for s, x, last in [("a", y[0], 5), ("b", y[1], 3)]:
        e, n = x - x.mean(), len(x)
        r = np.array([(e[k:] * e[: n - k]).sum() / (n - k) for k in range(last + 1)]) / e.var()
        for k in range(1, last + 1):
            toeplitz = r[np.abs(np.arange(k)[:, None] - np.arange(k)[None, :])]
            assert value[s, k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])


def unit(spark, past, y, f, lo=None, hi=None):
    lo, hi = lo or f, hi or f
    arr = lambda v: [None if x is None else float(x) for x in v]
    return spark.createDataFrame([("a", arr(past), arr(y), arr(f), arr(lo), arr(hi))], "series_id string, past array<double>, y array<double>, f array<double>, lo array<double>, hi array<double>")


@pytest.mark.parametrize("past,y,f,lo,hi,want", [
    ([1, 2, 3, 4], [1, 2, 3], [1, 2, 3], [0, 1, 2], [2, 3, 4], (1.0, 1.0, 1.0)),  # perfect
    ([1, 2, 3], [0, 0], [0, 0], [0, 0], [0, 0], (0.0, 0.0, 0.0)),  # nothing happened, nothing forecast
    ([0, 0, 0], [1, 2], [1, 2], [0, 1], [2, 3], (1.0, 1.0, 1.0)),  # nothing ever happened before
    ([1, 2, 3], [1, 5], [5, 1], [6, 6], [0, 0], (0.2, 1.0, 1.0)),  # equal totals, swapped bounds
])
def test_accuracy_metrics(spark, past, y, f, lo, hi, want):
    r = mt.score_units(unit(spark, past, y, f, lo, hi), metrics=["rpa", "rqa", "mia"]).first()
    assert (r.rpa, r.rqa, r.mia) == pytest.approx(want, abs=1e-4)


def test_scores_are_bounded_and_composite(spark):
    y, f = RNG.normal(10, 5, 26), RNG.normal(12, 5, 26)
    r = mt.score_units(unit(spark, RNG.normal(10, 5, 60), y, f, list(f - 3), list(f + 3))).first()
    assert all(0 <= r[m] <= 1 for m in mt.ALL_METRICS)
    assert r.predictability == pytest.approx((r.rpa + r.rqa + r.mia) / 3, abs=1e-4)
    assert r.effectiveness == pytest.approx((r.bds + r.ljb + r.runs) / 3, abs=1e-4)


def test_residual_guards(spark):
    same = mt.score_units(unit(spark, [1, 2, 3], [3, 4, 5, 6], [1, 2, 3, 4]), metrics=["bds", "ljb", "runs"]).first()
    exact = mt.score_units(unit(spark, [1, 2, 3], [3, 4], [3, 4]), metrics=["bds", "ljb", "runs"]).first()
    assert (same.bds, same.ljb, same.runs) == (0, 0, 0) and (exact.bds, exact.ljb, exact.runs) == (1, 1, 1)


def test_unequal_lengths_align_right(make):
    actual = make({"a": range(10)}).withColumn("part", F.when(F.col("pos") >= 7, "horizon").otherwise("past"))
    f = make({"a": [8, 9]}).select("series_id", (F.col("pos") + 8).alias("pos"), F.col("y").alias("mean"), F.col("y").alias("lower"), F.col("y").alias("upper"))
    u = mt.build_units(actual, f).first()
    assert u.y == [8.0, 9.0] and u.f == [8.0, 9.0]


def test_grouped_regression(spark):
    x = RNG.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + RNG.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "y": y, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2]}))
    r = grouped_ols(df, "y", ["x1", "x2", "x3"]).first()
    want, sse, *_ = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)
    assert r.beta == pytest.approx(want) and r.sse == pytest.approx(sse[0])


def holt_winters(y, a, b, g, m):
    level = np.mean(y[:m]); trend = (np.mean(y[m : 2 * m]) - level) / m
    season, fit = [v / level for v in y[:m]], []
    for t in range(m, len(y)):
        s = season.pop(0)
        fit.append((level + trend) * s)
        base, new = level + trend, a * y[t] / s + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season.append(g * y[t] / base + (1 - g) * s)
        level = new
    return fit, [(level + trend * k) * season[(k - 1) % m] for k in range(1, 7)]


def test_multiplicative_season(make):
    y = [(20 + 0.3 * t) * [0.8, 1.1, 1.3, 0.8][t % 4] + RNG.normal() for t in range(60)]
    out = fc.fc_ets(make({"a": y}), 6, trend="add", seasonal="mul", m=4).orderBy("pos").toPandas()
    best = min((sum((u - v) ** 2 for u, v in zip(y[4:], holt_winters(y, a, b, g, 4)[0])), a, b, g) for a in fc.COARSE_GRID for b in fc.COARSE_GRID for g in fc.COARSE_GRID)
    fit, ahead = holt_winters(y, *best[1:], 4)
    assert out["mean"].dropna().tolist() == pytest.approx(ahead) and out.fit.dropna().tolist()[4:] == pytest.approx(fit)


def test_long_path_uses_blocks(make):
    y = RNG.normal(10, 1, 600).tolist()
    out = fc.fc_ets(make({"a": y}), 2).where("fit is not null")
    assert out.count() == 600


def test_arma_recovers_parameters_and_forecasts(make):
    e = RNG.normal(size=1500)
    y = np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 2 + 0.7 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    past = make({"a": y})
    orders = past.select("series_id").distinct().withColumns({"d": F.lit(0), "ds": F.lit(0)})
    top = (1, 1, 0, 0)
    rows, best, xs = ar.fit_orders(past, orders, ar.candidate_orders([1], [1], [0], [0], top), top, 0, ["series_id"])
    b = best.first()
    assert b.beta[1] == pytest.approx(0.7, abs=0.08) and b.beta[2] == pytest.approx(0.4, abs=0.1)
    out = ar.fc_arima(past, 400, order=(1, 0, 1)).where("mean is not null").orderBy("pos").toPandas()
    assert out["mean"].iloc[-1] == pytest.approx(b.beta[0] / (1 - b.beta[1]), rel=1e-3)
    half = (out.upper - out["mean"]).to_numpy()
    psi = [1.0] + [(b.beta[1] + b.beta[2]) * b.beta[1] ** k for k in range(399)]
    assert half == pytest.approx(1.96 * np.sqrt(b.sigma2 * np.cumsum(np.square(psi))))


def test_differencing_orders(make):
    walk = RNG.normal(size=300).cumsum()
    noise = RNG.normal(size=300)
    got = {r.series_id: r.d for r in ar.estimate_d(make({"walk": walk, "noise": noise, "short": [1, 2, 3], "zero": [0] * 40})).collect()}
    assert got == {"walk": 1, "noise": 0, "short": 0, "zero": 0}


def test_seasonal_arima_forecast_follows_season(make):
    y = [10 * np.sin(2 * np.pi * t / 12) + 0.1 * RNG.normal() for t in range(240)]
    out = ar.fc_sarima(make({"a": y}), 12, order=(0, 0, 0), seasonal_order=(1, 1, 0, 12)).where("mean is not null").orderBy("pos").toPandas()
    assert np.abs(out["mean"] - [10 * np.sin(2 * np.pi * t / 12) for t in range(240, 252)]).max() < 1


def test_no_series_is_lost(make):
    past = make({"good": RNG.normal(10, 1, 60), "zero": [0] * 60, "tiny": [1, 2, 3]})
    for model, params in [("arima", {"order": (2, 1, 1)}), ("ets", {"seasonal": "add", "m": 12}), ("auto_arima", {"m": 12, "max_p": 1, "max_q": 1, "max_P": 1, "max_Q": 0})]:
        out = fc.forecast_panel(past, model, 4, **params).where("mean is not null").groupBy("series_id").count().collect()
        assert {r.series_id: r["count"] for r in out} == {"good": 4, "zero": 4, "tiny": 4}, model


def test_booster_takes_the_lags_of_each_series(make):
    wave = lambda n: [10 + (i % 4) + 0.1 * i for i in range(n)]
    p = make({"long1": wave(70), "long2": wave(66), "long3": wave(62), "long4": wave(70), "long5": wave(64), "short1": wave(12), "short2": wave(13), "tiny": wave(7), "one": [3]})
    out = gb.fc_gbt_panel(p, 3, m=None, draws=1, rounds=2)
    future = out.where(F.col("y").isNull()).groupBy("series_id").count().collect()
    assert {r.series_id: r["count"] for r in future} == {s: 3 for s in ("long1", "long2", "long3", "long4", "long5", "short1", "short2")}
    design = gb.own_lag_features(p.where("series_id in ('long1', 'short1')"), [1, 2, 3, 7, 14, 28], [7, 28], 12).toPandas()
    short, long = (design[design.series_id == s] for s in ("short1", "long1"))
    assert sorted(short.pos) == list(range(7, 12)) and sorted(long.pos) == list(range(28, 70))
    assert (short.lag14 == 0).all() and (short.has_14 == 0).all() and (long.has_28 == 1).all() and (short.sort_values("pos").lag7 == wave(5)).all()
    assert gb.fc_gbt_panel(p.where("series_id in ('tiny', 'one')"), 3, m=None, draws=1, rounds=2).count() == 0


def test_boosters_never_see_what_lies_ahead(make):
    rng = random.Random(3)
    wave = {f"s{i}": [10 + i + 5 * math.sin(t / 3 + i) + rng.random() for t in range(60)] for i in range(4)}
    panel = make(wave)
    cut = 44
    early = panel.where(f"pos <= {cut}").withColumn("window_id", F.lit(1))
    late = panel.withColumn("window_id", F.lit(2))
    changed = late.withColumn("y", F.when(F.col("pos") > cut, F.col("y") * 7 + F.col("pos") % 5).otherwise(F.col("y")))
    keys = ["window_id", "series_id"]

    def forecast(rows):
        out = gb.fc_gbt_panel(rows, 4, keys, m=None, draws=2, rounds=3)
        return sorted((r.window_id, r.series_id, r.pos, r["mean"], r.lower, r.upper, r.fit) for r in out.collect())

    a, b = forecast(early.unionByName(late)), forecast(early.unionByName(changed))
    first = lambda x: [r for r in x if r[0] == 1]
    assert len(first(a)) > 4 and first(a) == first(b) and a != b


def test_fit_dates_are_thinned_to_the_past(make):
    panel = make({f"s{i}": range(5 + i) for i in range(30)})
    for most in (1, 4, 30, 99):
        rows = gb.fit_dates(panel, max_fits=most).collect()
        assert len(rows) == 30 and all(r.fitted_to <= r.cut for r in rows)
        assert len({r.fitted_to for r in rows}) == min(most, 30)
