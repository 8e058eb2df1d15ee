"""Panel forecasters. Every model turns history rows into one forecast table.

Columns: keys, model_key, pos, ts, mean, lower, upper (future rows), fit, fit_lower, fit_upper
(history rows), y (history rows).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.functions import columns as c
from accuracast.functions.columns import ID
from accuracast.operators.cleaning import future_index
from accuracast.registry import MODELS, register_model
from accuracast.session import prepare, written

MEAN_BAND = 0.95
Z95 = 1.96
MIN_RESIDUALS = 5
SES_GRID = [round(0.1 * k, 1) for k in range(1, 10)]
COARSE_GRID = [0.1, 0.5, 0.9]
VALUES = ["mean", "lower", "upper", "fit", "fit_lower", "fit_upper"]


def model_key(model: str, h: int, keys: Sequence[str]) -> Column:
    return F.concat_ws("|", F.lit(model), F.lit(str(h)), F.col(keys[-1] if "series_id" not in keys else "series_id"))


def assemble(history: DataFrame, future: DataFrame, model: str, h: int, step: str | None, keys: Sequence[str]) -> DataFrame:
    """Stack history rows (pos, ts, y, fit*) and future rows (k, mean, lower, upper)."""
    prepare(history.sparkSession)
    if step is not None:
        ahead = future_index(history, h, step, keys).withColumn("k", F.row_number().over(c.over(keys)))
        future = future.join(ahead.select(*keys, "k", "ts"), [*keys, "k"])
    else:
        future = future.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    none = [F.lit(None).cast("double").alias(x) for x in VALUES]
    past = history.select(*keys, model_key(model, h, keys).alias("model_key"), F.col("pos").cast("bigint"), "ts", *none[:3], "fit", "fit_lower", "fit_upper", "y")
    new = future.select(*keys, model_key(model, h, keys).alias("model_key"), F.col("pos").cast("bigint"), "ts", "mean", "lower", "upper", *none[3:], F.lit(None).cast("double").alias("y"))
    return past.unionAll(new)


def steps(h: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(h))).alias("k")


@register_model("meanfill")
def fc_meanfill(past: DataFrame, h: int, keys: Sequence[str] = ID, step: str | None = None) -> DataFrame:
    """The mean of the history, with bounds 95 % of it away."""
    g = past.groupBy(*keys).agg(F.avg("y").alias("m"), F.max("pos").alias("_p"))
    low, high = F.bround(F.col("m") - MEAN_BAND * F.col("m"), 4), F.bround(F.col("m") + MEAN_BAND * F.col("m"), 4)
    future = g.select(*keys, steps(h), "m", "_p").select(*keys, "k", (F.col("_p") + F.col("k")).alias("pos"), F.col("m").alias("mean"), low.alias("lower"), high.alias("upper"))
    history = past.join(g, list(keys)).select(*keys, "pos", "ts", "y", F.col("m").alias("fit"), low.alias("fit_lower"), high.alias("fit_upper"))
    return assemble(history, future, "MEANFILL", h, step, keys)


# ---- exponential smoothing ----------------------------------------------------------------------


class Smoothing:
    """State recursion of one trend / seasonal combination as array expressions."""

    def __init__(self, trend: str | None, seasonal: str | None, m: int):
        self.trend, self.seasonal, self.m = trend, seasonal, m
        self.start = m if seasonal else (2 if trend else 1)

    def initial(self, ys: Column) -> dict[str, Column]:
        at = lambda k: F.get(ys, F.lit(k))
        if self.seasonal:
            first, second = F.slice(ys, 1, self.m), F.slice(ys, self.m + 1, self.m)
            level = c.mean(first)
            gap = (c.mean(second) - level) / self.m
            growth = F.pow(F.try_divide(c.mean(second), level), F.lit(1.0 / self.m))
            rel = lambda a, b: F.try_divide(a, b) if self.seasonal == "mul" else a - b
            season = F.zip_with(first, F.array_repeat(level, self.m), rel)
        else:
            level = at(1) if self.trend else at(0)
            gap, growth = at(1) - at(0), F.try_divide(at(1), at(0))
            season = F.array().cast("array<double>")
        b = {"add": gap, "mul": growth}.get(self.trend, F.lit(0.0))
        return {"level": level.cast("double"), "trend": b.cast("double"), "season": season}

    def ahead(self, s: Column, k: Column | int = 1) -> Column:
        """Level moved k steps by the trend."""
        if self.trend == "add":
            return s["level"] + s["trend"] * k
        return s["level"] * F.pow(s["trend"], F.lit(k).cast("double") if isinstance(k, int) else k.cast("double")) if self.trend == "mul" else s["level"]

    def with_season(self, base: Column, season: Column) -> Column:
        if not self.seasonal:
            return base
        return base * season if self.seasonal == "mul" else base + season

    def step(self, s: Column, y: Column, a: Column, b: Column, g: Column) -> dict[str, Column]:
        off = lambda x, z: F.try_divide(x, z) if self.seasonal == "mul" else x - z
        base = self.ahead(s)
        old = F.get(s["season"], F.lit(0)) if self.seasonal else F.lit(0.0)
        seen = off(y, old) if self.seasonal else y
        level = a * seen + (1 - a) * base
        trend = {"add": b * (level - s["level"]) + (1 - b) * s["trend"], "mul": b * F.try_divide(level, s["level"]) + (1 - b) * s["trend"]}.get(self.trend, F.lit(0.0))
        season = s["season"]
        if self.seasonal:
            season = F.concat(F.slice(season, 2, self.m - 1), F.array(g * off(y, base) + (1 - g) * old))
        return {"level": level, "trend": trend, "season": season, "fit": self.with_season(base, old)}

    def grid(self) -> list[tuple[float, float, float]]:
        one = SES_GRID if not self.seasonal else COARSE_GRID
        return list(itertools.product(one, one if self.trend else [0.0], one if self.seasonal else [0.0]))

    def sse(self, ys: Column) -> Column:
        """Sum of squared one-step errors for the parameters in columns a, b, g."""
        start = {**self.initial(ys), "sse": F.lit(0.0)}
        a, b, g = F.col("a"), F.col("b"), F.col("g")

        def merge(acc, y):
            new = self.step(acc, y, a, b, g)
            miss = y - new.pop("fit")
            return F.struct(*[v.alias(k) for k, v in new.items()], (acc["sse"] + miss * miss).alias("sse"))

        return F.aggregate(c.tail(ys, F.lit(self.start)), F.struct(*[v.alias(k) for k, v in start.items()]), merge, lambda acc: acc["sse"])

    def path(self, ys: Column, block: int = 256) -> Column:
        """Final state and all fitted values. Values are appended per block, then blocks are
        appended, so a long series does not copy its whole output at every step."""
        empty = F.array().cast("array<double>")
        start = {**self.initial(ys), "out": empty}
        a, b, g = F.col("a"), F.col("b"), F.col("g")
        rest = c.tail(ys, F.lit(self.start))
        count = F.ceil(F.size(rest) / block).cast("int")
        blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.slice(rest, j * block + 1, block))).otherwise(F.array().cast("array<array<double>>"))

        def one(acc, y):
            new = self.step(acc, y, a, b, g)
            fit = new.pop("fit")
            return F.struct(*[v.alias(k) for k, v in new.items()], F.concat(acc["out"], F.array(fit)).alias("out"))

        def many(acc, ys_):
            s = acc["s"]
            fresh = F.struct(s["level"].alias("level"), s["trend"].alias("trend"), s["season"].alias("season"), empty.alias("out"))
            return F.struct(F.aggregate(ys_, fresh, one).alias("s"), F.concat(acc["done"], F.array(s["out"])).alias("done"))

        first = F.struct(F.struct(*[v.alias(k) for k, v in start.items()]).alias("s"), F.array().cast("array<array<double>>").alias("done"))
        return F.aggregate(blocks, first, many, lambda acc: F.struct(acc["s"].alias("s"), F.flatten(F.concat(acc["done"], F.array(acc["s"]["out"]))).alias("fits")))


def fit_ets(past: DataFrame, trend: str | None = None, seasonal: str | None = None, m: int = 52, keys: Sequence[str] = ID) -> tuple[Smoothing, DataFrame]:
    """Grid search: series x parameter rows, smallest error per series wins (ties: smaller parameters)."""
    seasonal = seasonal if m and m >= 2 else None
    s = Smoothing(trend, seasonal, m)
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g")) for a, b, g in s.grid()])
    need = 2 * m if seasonal else s.start + 1
    arr = c.series_arrays(past, keys).where(F.col("n") >= need).select(*keys, "ys")
    cand = arr.select(*keys, "ys", F.explode(grid).alias("_g")).select(*keys, "ys", "_g.a", "_g.b", "_g.g")
    scored = cand.select(*keys, "a", "b", "g", s.sse(F.col("ys")).alias("sse")).where(F.col("sse").isNotNull())
    best = scored.groupBy(*keys).agg(F.min(F.struct("sse", "a", "b", "g")).alias("_b")).select(*keys, "_b.a", "_b.b", "_b.g", "_b.sse")
    return s, arr.join(best, list(keys))


def residual_bounds(df: DataFrame) -> DataFrame:
    """Adds q_lo / q_hi: residual quantiles, or 1.96 standard deviations when there are too few."""
    df = df.withColumns({"_r": F.array_sort("res")})
    n = F.size("res")
    mean = c.total(F.col("res")) / F.when(n > 0, n)
    ss = c.dot(F.col("res"), F.col("res")) - n * mean * mean
    sd = F.when(n > 1, F.sqrt(F.greatest(ss, F.lit(0.0)) / (n - 1)))
    lo = F.when(n >= MIN_RESIDUALS, c.sorted_quantile(F.col("_r"), 0.025)).otherwise(-Z95 * sd)
    hi = F.when(n >= MIN_RESIDUALS, c.sorted_quantile(F.col("_r"), 0.975)).otherwise(Z95 * sd)
    return df.withColumns({"q_lo": lo, "q_hi": hi}).drop("_r")


@register_model("ets")
def fc_ets(past: DataFrame, h: int, keys: Sequence[str] = ID, step: str | None = None, trend: str | None = None, seasonal: str | None = None, m: int = 52) -> DataFrame:
    """Exponential smoothing with additive or multiplicative trend and season.

    Bounds are the 2.5 and 97.5 % residual quantiles around the forecast, the value a residual
    bootstrap approaches with many draws.
    """
    s, fit = fit_ets(past, trend, seasonal, m, keys)
    full = fit.withColumn("_p", s.path(F.col("ys"))).select("*", F.col("_p.s").alias("s"), F.col("_p.fits").alias("fits"))
    head = F.slice("ys", 1, s.start)
    full = full.withColumn("res", F.zip_with(c.tail(F.col("ys"), F.lit(s.start)), "fits", lambda a, b: a - b))
    full = residual_bounds(full).withColumn("fits", F.concat(head, "fits"))
    ends = past.groupBy(*keys).agg(F.max("pos").alias("_last"))
    k = F.col("k")
    season = F.get("s.season", (k - 1) % F.lit(s.m)) if s.seasonal else F.lit(0.0)
    future = full.join(ends, list(keys)).select(*keys, "s", "q_lo", "q_hi", "_last", steps(h)).withColumn("mean", s.with_season(s.ahead(F.col("s"), k), season))
    future = future.select(*keys, "k", (F.col("_last") + k).alias("pos"), "mean", (F.col("mean") + F.col("q_lo")).alias("lower"), (F.col("mean") + F.col("q_hi")).alias("upper"))
    history = attach_fits(past, full, keys)
    return assemble(history, future, f"ETS(trend={trend},seasonal={s.seasonal},m={m})", h, step, keys)


def attach_fits(past: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fitted arrays back on the history rows they belong to, with residual-quantile bounds."""
    rows = fitted.select(*keys, "q_lo", "q_hi", F.posexplode("fits").alias("_i", "fit"))
    index = past.where(F.col("y").isNotNull()).withColumn("_i", F.row_number().over(c.over(keys)) - 1)
    return index.join(rows, [*keys, "_i"]).select(
        *keys, "pos", "ts", "y", "fit", (F.col("fit") + F.col("q_lo")).alias("fit_lower"), (F.col("fit") + F.col("q_hi")).alias("fit_upper")
    )


def forecast_panel(past: DataFrame, model: str, h: int, keys: Sequence[str] = ID, step: str | None = None, **params) -> DataFrame:
    """Forecast every series with a registered model; series it cannot fit get the mean forecast."""
    out = MODELS[model].build(past, h, keys=keys, step=step, **params)
    if model == "meanfill":
        return out
    out = written(out, "forecast")  # read twice: the result, and which series it covers
    done = out.where(F.col("mean").isNotNull()).select(*keys).distinct()
    rest = past.join(done, list(keys), "left_anti")
    return out.unionByName(fc_meanfill(rest, h, keys, step))
