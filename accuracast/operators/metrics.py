"""Bounded accuracy metrics and composite scores of forecasts.

A *unit* is one row per forecast: arrays ``past`` (history), ``y`` (actuals), ``f``, ``lo``, ``hi``
(forecast and bounds). Everything below is array arithmetic on that row, so scoring costs the one
shuffle that builds the units, and a bootstrap replicate is the same row with resampled arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.functions import columns as c
from accuracast.functions.columns import ID
from accuracast.functions.stats import chi2_tail, normal_two_sided
from accuracast.operators.features import close_pairs_udf
from accuracast.registry import METRICS, register_metric
from accuracast.session import prepare

EPS = 1e-12
IQR_TO_SD = 1.349
PREDICTABILITY = ["rpa", "rqa", "mia"]
EFFECTIVENESS = ["bds", "ljb", "runs"]
SCORES = ["predictability", "effectiveness"]
ALL_METRICS = ["predictability", *PREDICTABILITY, "effectiveness", *EFFECTIVENESS]


def build_units(actuals: DataFrame, forecast: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Past and horizon rows of ``actuals`` (part column) with the future rows of ``forecast``.

    The two are stacked and grouped once. Arrays align from the right and a unit without forecast
    or without horizon is left out.
    """
    prepare(actuals.sparkSession)
    none = F.lit(None).cast("double")
    a = actuals.select(*keys, "pos", "y", none.alias("mean"), none.alias("lower"), none.alias("upper"), "part")
    f = forecast.where(F.col("mean").isNotNull()).select(*keys, "pos", none.alias("y"), "mean", "lower", "upper", F.lit("forecast").alias("part"))
    past, horizon, ahead = (F.col("part") == p for p in ("past", "horizon", "forecast"))
    g = a.unionAll(f).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(past & F.col("y").isNotNull(), F.struct("pos", "y")))).alias("_p"),
        F.sort_array(F.collect_list(F.when(horizon, F.struct("pos", "y")))).alias("_y"),
        F.sort_array(F.collect_list(F.when(ahead, F.struct("pos", "mean", "lower", "upper")))).alias("_f"),
    )
    k = F.least(F.size("_y"), F.size("_f"))
    g = g.where(k > 0)
    last = lambda arr: F.slice(arr, F.size(arr) - k + 1, k)
    return g.select(
        *keys, F.transform("_p", lambda s: s["y"]).alias("past"), F.transform(last(F.col("_y")), lambda s: s["y"]).alias("y"),
        *[c.pluck(last(F.col("_f")), name).alias(out) for name, out in [("mean", "f"), ("lower", "lo"), ("upper", "hi")]],
    )


def insample_units(fitted: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Units of a model against its own history: rows with y, fit, fit_lower, fit_upper."""
    rows = fitted.where(F.col("fit").isNotNull() & F.col("y").isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "y", "fit", "fit_lower", "fit_upper"))).alias("_s")
    )
    pick = lambda n: F.transform("_s", lambda s: s[n])
    return rows.select(*keys, pick("y").alias("past"), pick("y").alias("y"), pick("fit").alias("f"), pick("fit_lower").alias("lo"), pick("fit_upper").alias("hi"))


def pair_sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def with_scale(units: DataFrame) -> DataFrame:
    """Adds ``scale``: median absolute deviation of the past, else IQR, else mean size, else 1."""
    u = units.withColumn("_s", F.array_sort("past"))
    u = u.withColumns({"_med": c.sorted_quantile(F.col("_s"), 0.5), "_iqr": c.sorted_quantile(F.col("_s"), 0.75) - c.sorted_quantile(F.col("_s"), 0.25)})
    dev = F.array_sort(F.zip_with("_s", F.array_repeat("_med", F.size("_s")), lambda a, b: F.abs(a - b)))
    u = u.withColumn("_d", dev).withColumns({"_mad": c.sorted_quantile(F.col("_d"), 0.5), "_size": c.mean(F.transform("past", F.abs))})
    scale = (
        F.when(F.col("_mad") > EPS, F.col("_mad"))
        .when(F.col("_iqr") > EPS, F.col("_iqr") / IQR_TO_SD)
        .when(F.col("_size") > EPS, F.col("_size"))
        .otherwise(F.greatest(F.lit(EPS), F.coalesce("_size", F.lit(0.0)), F.lit(1.0)))
    )
    return u.withColumn("scale", scale).drop("_s", "_med", "_iqr", "_d", "_mad", "_size")


def zero_guard(value: Column) -> Column:
    """Nothing happened and nothing was forecast: 0. Nothing ever happened before: 1."""
    nothing = (F.array_max("y") == 0) & (F.array_max("f") == 0)
    return F.when(nothing, 0.0).when(F.array_max("past") == 0, 1.0).otherwise(value)


@register_metric("rpa", bounded_01=True, family="predictability")
def rpa() -> Column:
    err = F.filter(F.zip_with("y", "f", lambda a, b: F.abs(a - b)), lambda e: e.isNotNull())
    acc = F.aggregate(
        err, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.col("scale").alias("c")),
        lambda acc, e: F.struct((acc["s"] + e / (e + acc["c"] + EPS)).alias("s"), (acc["n"] + 1).alias("n"), acc["c"].alias("c")),
        lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]).otherwise(1.0),
    )
    return zero_guard(1 - F.bround(acc, 4))


@register_metric("rqa", bounded_01=True, family="predictability")
def rqa() -> Column:
    nonull = lambda a: F.filter(a, lambda v: v.isNotNull())
    err = F.abs(c.total(nonull(F.col("y"))) - c.total(nonull(F.col("f"))))
    return zero_guard(1 - F.bround(err / (err + F.greatest(F.lit(EPS), F.size("y") * F.col("scale")) + EPS), 4))


@register_metric("mia", bounded_01=True, family="predictability")
def mia() -> Column:
    miss = F.zip_with(
        F.zip_with("lo", "hi", lambda a, b: F.struct(F.when(a > b, b).otherwise(a).alias("a"), F.when(a > b, a).otherwise(b).alias("b"))), "y",
        lambda s, v: F.when((v < s["a"]) | (v > s["b"]), 1.0).otherwise(0.0),
    )
    nonull = lambda a: c.total(F.filter(a, lambda v: v.isNotNull()))
    same = (nonull(F.col("y")) == nonull(F.col("lo"))) & (nonull(F.col("lo")) == nonull(F.col("hi")))
    return F.when(same, 0.0).otherwise(1 - c.total(miss) / F.size("y"))


def with_residuals(units: DataFrame) -> DataFrame:
    """Adds residuals ``e`` (complete pairs) and what the dependence tests share."""
    u = units.withColumn("e", F.filter(F.zip_with("y", "f", lambda a, b: a - b), lambda v: v.isNotNull()))
    u = u.withColumns({"en": F.size("e"), "esum": c.total(F.col("e"))})
    return u.withColumn("emu", F.when(F.col("en") > 0, F.col("esum") / F.col("en"))).withColumn(
        "_es", F.zip_with("e", F.array_repeat("emu", F.col("en")), lambda a, b: a - b)
    ).withColumn("_ess", c.dot(F.col("_es"), F.col("_es")))


def residual_guard(value: Column, short: float = 1.0) -> Column:
    return (
        F.when(F.col("en") < 2, short).when(F.col("esum") == 0, 1.0).when(F.array_min("e") == F.array_max("e"), 0.0).otherwise(F.coalesce(value, F.lit(1.0)))
    )


def with_effectiveness(units: DataFrame) -> DataFrame:
    """Adds bds, ljb, runs (p-values of the residual tests) and their statistics."""
    u = with_residuals(units)
    # portmanteau test
    u = u.withColumn("ljb_lags", F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.col("en") / 4).cast("int"))))
    rho2 = F.transform(F.when(F.col("en") > 1, F.sequence(F.lit(1), F.col("ljb_lags"))).otherwise(F.array().cast("array<int>")),
                       lambda k: F.pow(c.lag_dot(F.col("_es"), k), F.lit(2.0)) / (F.col("en") - k))
    u = u.withColumn("ljb_stat", F.when(F.col("_ess") > 0, F.col("en") * (F.col("en") + 2.0) * c.total(rho2) / (F.col("_ess") * F.col("_ess"))))
    # runs of residual signs, zeros dropped
    u = u.withColumn("_sg", F.transform(F.filter("e", lambda v: v != 0), lambda v: F.when(v > 0, 1).otherwise(-1)))
    u = u.withColumns({
        "_n1": F.size(F.filter("_sg", lambda v: v > 0)).cast("double"), "_n2": F.size(F.filter("_sg", lambda v: v < 0)).cast("double"),
        "_runs": 1 + c.total(F.zip_with(c.head(F.col("_sg"), F.lit(1)), c.tail(F.col("_sg"), F.lit(1)), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))),
    })
    n, prod = F.col("_n1") + F.col("_n2"), 2 * F.col("_n1") * F.col("_n2")
    var = F.when(n > 1, prod * (prod - n) / (n * (n - 1) * n))
    u = u.withColumn("_var", var).withColumn("runs_stat", F.when(F.col("_var") > 0, (F.col("_runs") - (prod / n + 1)) / F.sqrt("_var")))
    # correlation integrals
    sd = F.when(F.col("en") > 1, F.sqrt(F.col("_ess") / (F.col("en") - 1)))
    ok = (F.col("en") > 2) & (F.col("_ess") > 0)
    u = u.withColumn("_k", close_pairs_udf()(F.when(ok, F.col("e")).otherwise(F.array().cast("array<double>")), F.coalesce(1.5 * sd, F.lit(0.0))))
    m = F.col("en").cast("double")
    u = u.select("*", *[F.when(ok, v).alias(a) for a, v in [
        ("_p1", 2 * F.col("_k.c1") / (m * (m - 1))), ("_p1i", 2 * F.col("_k.c1_inner") / ((m - 1) * (m - 2))), ("_p2", 2 * F.col("_k.c2") / ((m - 1) * (m - 2))),
        ("_k3", (F.col("_k.sq") - 3 * F.col("_k.rows") + 2 * m) / (m * (m - 1) * (m - 2)))]])
    bsd = 2 * F.abs(F.col("_k3") - F.col("_p1") * F.col("_p1"))
    u = u.withColumn("bds_stat", F.when(bsd > EPS, F.sqrt(m - 1) * (F.col("_p2") - F.col("_p1i") * F.col("_p1i")) / bsd))
    runs = F.when(n < 2, 1.0).when((F.col("_n1") == 0) | (F.col("_n2") == 0), 0.0).when(F.col("runs_stat").isNull(), 1.0).otherwise(
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), normal_two_sided("runs_stat"))), 4)
    )
    u = u.withColumns({
        "bds": residual_guard(F.when(F.col("bds_stat").isNotNull(), normal_two_sided("bds_stat"))),
        "ljb": residual_guard(F.when(F.col("ljb_stat").isNotNull(), chi2_tail("ljb_stat", "ljb_lags"))),
        "runs": residual_guard(runs),
    })
    return u.drop("_es", "_ess", "_sg", "_n1", "_n2", "_runs", "_var", "_k", "_p1", "_p1i", "_p2", "_k3")


def with_predictability(units: DataFrame) -> DataFrame:
    u = units if "scale" in units.columns else with_scale(units)
    return u.withColumns({n: METRICS[n].build() for n in PREDICTABILITY})


def composite(parts: Sequence[str]) -> Column:
    """Mean of the parts; missing when a part is missing."""
    return F.bround(sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts), 4)


def score_units(units: DataFrame, keys: Sequence[str] = ID, metrics: Sequence[str] = ALL_METRICS) -> DataFrame:
    """Wide scores per unit. Only the families asked for are computed; a ``scale`` that units bring along is used."""
    u = units
    if set(metrics) & {"predictability", *PREDICTABILITY}:
        u = with_predictability(u).withColumn("predictability", composite(PREDICTABILITY))
    if set(metrics) & {"effectiveness", *EFFECTIVENESS}:
        u = with_effectiveness(u).withColumn("effectiveness", composite(EFFECTIVENESS))
    extra = [m for m in metrics if m not in ALL_METRICS]
    if extra:
        u = u if "scale" in u.columns else with_scale(u)
        u = u.withColumns({m: METRICS[m].build() for m in extra})
    return u.select(*keys, *[c.finite(F.col(m).cast("double")).alias(m) for m in metrics])


def evaluate_forecasts(actuals: DataFrame, forecast: DataFrame, keys: Sequence[str] = ID, metrics: Sequence[str] = ALL_METRICS) -> DataFrame:
    """fc_eval: keys, metric, value for every forecast with actuals."""
    wide = score_units(build_units(actuals, forecast, keys), keys, metrics)
    return wide.unpivot(list(keys), list(metrics), "metric", "value").where(F.col("value").isNotNull())


@register_metric("bds", bounded_01=True, family="effectiveness")
def bds() -> Column:
    return F.col("bds")


@register_metric("ljb", bounded_01=True, family="effectiveness")
def ljb() -> Column:
    return F.col("ljb")


@register_metric("runs", bounded_01=True, family="effectiveness")
def runs() -> Column:
    return F.col("runs")


@register_metric("smape", family="error")
def smape() -> Column:
    pairs = F.filter(F.zip_with("y", "f", lambda a, b: F.struct(F.abs(a - b).alias("e"), (F.abs(a) + F.abs(b)).alias("d"))), lambda s: s["e"].isNotNull())
    used = F.filter(pairs, lambda s: s["d"] >= EPS)
    value = c.mean(F.transform(used, lambda s: s["e"] / s["d"]))
    nothing = (c.total(F.col("y")) == 0) & (c.total(F.col("f")) == 0)
    return F.when(F.size(pairs) == 0, 0.0).otherwise(F.coalesce(value, F.when(nothing, 0.0).otherwise(1.0)))


def _errors() -> Column:
    return F.filter(F.zip_with("y", "f", lambda a, b: a - b), lambda e: e.isNotNull())


@register_metric("mae", family="error")
def mae() -> Column:
    return c.mean(F.transform(_errors(), F.abs))


@register_metric("rmse", family="error")
def rmse() -> Column:
    return F.sqrt(c.mean(F.transform(_errors(), lambda e: e * e)))
