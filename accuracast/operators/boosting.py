"""Gradient boosting over the pooled lag design of all series."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accuracast.functions.columns import ID, over, total
from accuracast.operators.cleaning import future_index, periodic_calendar
from accuracast.operators.forecasters import assemble
from accuracast.operators.windows import time_split
from accuracast.registry import register_model
from accuracast.session import checkpointed, written

# Lags and rolling windows of the design, before the season is added.
BASE_LAGS = [1, 2, 3, 7, 14, 28]
ROLLING = [7, 28]
CALENDAR = ["weekday", "month", "weekday_sin", "weekday_cos", "month_sin", "month_cos"]
MIN_ROWS = 5
SEED = 42
ROUNDS_PER_CHECKPOINT = 6
#: Boosters of one call at most; each is fitted on the past of its date.
MAX_FITS = 24


def design_shape(m: int | None, shortest: int) -> tuple[list[int], list[int]]:
    """Lags and rolling windows that fit into a series of ``shortest`` points."""
    season = [m, 2 * m] if m and m > 1 else []
    lags = sorted({k for k in BASE_LAGS + season if k < shortest})
    rolls = sorted({w for w in ROLLING + ([m] if m else []) if 2 <= w < shortest})
    return lags, rolls


def _lag_columns(lags: Sequence[int], rolls: Sequence[int], keys: Sequence[str]) -> list[Column]:
    w = over(keys)
    cols = [F.lag("y", k).over(w).alias(f"lag{k}") for k in lags]
    for r in rolls:
        frame = w.rowsBetween(-r, -1)
        full = F.count("y").over(frame) == r
        cols += [F.when(full, F.avg("y").over(frame)).alias(f"roll_mean_{r}"), F.when(full, F.stddev_samp("y").over(frame)).alias(f"roll_std_{r}")]
    return cols


def lag_features(past: DataFrame, lags: Sequence[int], rolls: Sequence[int], keys: Sequence[str] = ID) -> DataFrame:
    """Design matrix: lags, rolling mean and deviation of earlier values, calendar; complete rows only."""
    rows = past.where(F.col("y").isNotNull()).select(*keys, "pos", "ts", "y", *_lag_columns(lags, rolls, keys))
    return periodic_calendar(rows.dropna(subset=[x for x in rows.columns if x.startswith(("lag", "roll"))]))


def own_lags(rows: DataFrame, lags: Sequence[int], rolls: Sequence[int], shortest: int) -> DataFrame:
    """``rows`` with the lags and windows a series of ``n`` points does not have at 0, and ``has_k`` for
    those that not every series has."""
    held = {f"lag{k}": k for k in lags} | {f"{x}_{r}": r for r in rolls for x in ("roll_mean", "roll_std")}
    rows = rows.withColumns({c: F.when(F.col("n") > k, F.col(c)).otherwise(0.0) for c, k in held.items() if k >= shortest})
    return rows.withColumns({f"has_{k}": (F.col("n") > k).cast("double") for k in sorted(set(held.values())) if k >= shortest})


def own_lag_features(past: DataFrame, lags: Sequence[int], rolls: Sequence[int], shortest: int, keys: Sequence[str] = ID) -> DataFrame:
    """``lag_features`` where each series needs only the lags and windows shorter than itself."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = past.where(F.col("y").isNotNull()).select(*keys, "pos", "ts", "y", *_lag_columns(lags, rolls, keys), n.alias("n"))
    rows = own_lags(rows, lags, rolls, shortest)
    return periodic_calendar(rows.dropna(subset=[x for x in rows.columns if x.startswith(("lag", "roll"))])).drop("n")


def design_names(lags: Sequence[int], rolls: Sequence[int], shortest: int) -> list[str]:
    has = [f"has_{k}" for k in sorted({*lags, *rolls}) if k >= shortest]
    return [f"lag{k}" for k in lags] + [f"{n}_{r}" for r in rolls for n in ("roll_mean", "roll_std")] + has + CALENDAR


def draw_parameters(rng: random.Random) -> dict:
    """One random set of tree parameters."""
    return {
        "maxDepth": rng.choice([4, 5, 6]), "minInstancesPerNode": rng.choice([20, 50, 100]), "subsamplingRate": rng.choice([0.6, 0.8, 1.0]),
        "stepSize": rng.choice([0.05, 0.1]), "featureSubsetStrategy": rng.choice(["0.6", "0.8", "all"]),
    }


def cut_dates(past: DataFrame, keys: Sequence[str] = ID, max_fits: int = MAX_FITS) -> list:
    """Dates whose past boosters are fitted on: the last stamps of the series, evenly thinned to ``max_fits``.

    The first is always among them, so every series has a date not after its own end. A panel has no more
    last stamps than its calendar has steps, and only these reach the driver.
    """
    ends = past.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.max("ts").alias("cut"))
    dates = sorted(r.cut for r in ends.select("cut").distinct().collect() if r.cut is not None)
    if len(dates) <= max_fits:
        return dates
    return [dates[i * len(dates) // max_fits] for i in range(max_fits)]


def fit_dates(past: DataFrame, keys: Sequence[str] = ID, max_fits: int = MAX_FITS, dates: list | None = None) -> DataFrame:
    """Per series: ``cut`` (its last stamp), ``fitted_to`` (the last stamp its booster has seen) and ``fit``
    (the number of that date). ``fitted_to`` is never after ``cut``, hence before the first step ahead."""
    dates = cut_dates(past, keys, max_fits) if dates is None else dates
    ends = past.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.max("ts").alias("cut"))
    known = F.array(*[F.lit(d) for d in dates]).cast("array<timestamp_ntz>")
    number = F.greatest(F.size(F.filter(known, lambda d: d <= F.col("cut"))) - 1, F.lit(0))
    return ends.withColumn("fit", number).withColumn("fitted_to", F.get(known, F.col("fit")))


def fit_booster(train: DataFrame, names: Sequence[str], draws: int, rounds: int, chosen: dict | None = None):
    """(model, parameters): best of random parameter draws by validation error, or the ``chosen`` ones;
    early stopping on the validation rows."""
    rng, best = random.Random(SEED), (math.inf, None, None)
    data = VectorAssembler(inputCols=list(names), outputCol="x").transform(train).select("x", "target", "is_validation")
    data = written(data, "design")
    for _ in range(1 if chosen else draws):
        drawn = chosen or draw_parameters(rng)
        gbt = GBTRegressor(featuresCol="x", labelCol="target", predictionCol="predicted", validationIndicatorCol="is_validation", maxIter=rounds, seed=SEED, **drawn)
        model = gbt.fit(data)
        if chosen:
            return model, chosen
        err = model.transform(data.where("is_validation")).agg(F.avg((F.col("target") - F.col("predicted")) * (F.col("target") - F.col("predicted")))).first()[0]
        if err is not None and err < best[0]:
            best = (err, model, drawn)
    return best[1:]


def array_design(lags: Sequence[int], rolls: Sequence[int]) -> list[Column]:
    """The design of the next step from ``tail``, values newest first."""
    cols = [F.get("tail", F.lit(k - 1)).alias(f"lag{k}") for k in lags]
    for r in rolls:
        part = F.slice("tail", 1, r)
        mean = total(part) / r
        ss = F.aggregate(part, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda acc, v: F.struct((acc["s"] + (v - acc["m"]) * (v - acc["m"])).alias("s"), acc["m"].alias("m")), lambda acc: acc["s"])
        cols += [mean.alias(f"roll_mean_{r}"), F.sqrt(ss / (r - 1)).alias(f"roll_std_{r}")]
    return cols


def _ahead(state: DataFrame, model, assembler: VectorAssembler, h: int, lags: Sequence[int], rolls: Sequence[int], shortest: int, keys: Sequence[str]) -> DataFrame:
    """``path``: h recursive steps of one model over the states of its series."""
    size = max([*lags, *rolls])
    carried = [*keys, "n", "scale", "q", "ahead", "tail", "path"]
    for k in range(h):
        now = state.select(*carried, F.get("ahead", F.lit(k))["ts"].alias("ts"), *array_design(lags, rolls))
        scored = model.transform(assembler.transform(periodic_calendar(own_lags(now, lags, rolls, shortest))))
        state = scored.select(*keys, "n", "scale", "q", "ahead", F.concat(F.array("predicted"), F.slice("tail", 1, size - 1)).alias("tail"), F.concat("path", F.array("predicted")).alias("path"))
        if (k + 1) % ROUNDS_PER_CHECKPOINT == 0:
            state = checkpointed(state)
    return state.select(*keys, "scale", "q", "ahead", "path")


@register_model("gbt_panel")
def fc_gbt_panel(past: DataFrame, h: int, keys: Sequence[str] = ID, step: str | None = "week", m: int | None = 52, draws: int = 20, rounds: int = 50, max_fits: int = MAX_FITS) -> DataFrame:
    """Pooled boosters on scaled values, recursive forecasts, residual-quantile bounds.

    No booster sees what lies ahead of the series it forecasts. Series are pooled by the date they end:
    one booster per such date (``fit_dates``; the parameters are drawn at the first of them, the later ones
    only fit), on the rows of all series that end by then, whose scale comes from these rows too. With more
    than ``max_fits`` dates a series takes the booster of the last date not after its end. A study's
    windows, each with an end of its own, thus never learn from later windows or their horizons.

    The design has the lags of the longest series. A series uses those shorter than itself; the others
    are 0 and marked by an indicator. Series with fewer than MIN_ROWS rows by their own lags get no rows
    here and the caller falls back to the mean.
    """
    step = step or "week"
    scale = F.avg(F.abs("y")).over(Window.partitionBy(*keys))
    rows = past.where(F.col("y").isNotNull()).withColumn("scale", F.when(scale > 0, scale).otherwise(1.0))
    rows = written(rows.select(*keys, "pos", "ts", (F.col("y") / F.col("scale")).alias("y"), "scale"), "scaled")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    spans = sorted({1, *BASE_LAGS, *ROLLING, *([m, 2 * m] if m and m > 1 else [])})
    sizes = sizes.where(F.col("n") - F.greatest(F.lit(0), *[F.when(F.col("n") > k, k) for k in spans]) >= MIN_ROWS)
    shortest, longest = sizes.agg(F.min("n"), F.max("n")).first()
    if shortest is None:
        return assemble(rows.select(*keys, "pos", "ts", "y", *[F.lit(None).cast("double").alias(x) for x in ["fit", "fit_lower", "fit_upper"]]).limit(0),
                        rows.select(*keys, F.lit(1).alias("k"), "pos", *[F.lit(None).cast("double").alias(x) for x in ["mean", "lower", "upper"]]).limit(0), "GBT", h, step, keys)
    lags, rolls = design_shape(m, int(longest))
    names = design_names(lags, rolls, shortest)
    eligible = rows.join(sizes, list(keys), "left_semi")
    dates = cut_dates(eligible, keys, max_fits)
    ends = fit_dates(eligible, keys, max_fits, dates).select(*keys, "cut", "fit")
    design = own_lag_features(eligible, lags, rolls, shortest, keys)
    design = design.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_k") >= MIN_ROWS)
    design = written(time_split(design, keys=keys).withColumnRenamed("y", "target").join(ends, list(keys)), "design")
    assembler = VectorAssembler(inputCols=names, outputCol="x")
    models, chosen = [], None
    for date in dates or [None]:
        model, chosen = fit_booster(design.where(F.col("cut") <= F.lit(date)) if date is not None else design, names, draws, rounds, chosen)
        models.append(model)
    fitted = [model.transform(assembler.transform(design.where(F.col("fit") == i))).select(*keys, "pos", "ts", "target", "predicted") for i, model in enumerate(models)]
    fitted = written(reduce(DataFrame.union, fitted), "fitted")
    bands = fitted.groupBy(*keys).agg(F.percentile(F.col("target") - F.col("predicted"), [0.05, 0.95]).alias("q"))
    size = max([*lags, *rolls])
    recent = rows.withColumn("_b", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("pos").desc()))).where(F.col("_b") <= size)
    state = recent.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_b", "y"))), lambda s: s["y"]).alias("tail"), F.max("scale").alias("scale"))
    state = state.join(bands, list(keys)).join(sizes, list(keys)).withColumn("path", F.array().cast("array<double>"))
    stamps = future_index(past, h, step, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "ts"))).alias("ahead"))
    state = written(state.join(stamps, list(keys)).join(ends.select(*keys, "fit"), list(keys)), "state")
    state = reduce(DataFrame.union, [_ahead(state.where(F.col("fit") == i), model, assembler, h, lags, rolls, shortest, keys) for i, model in enumerate(models)])
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    future = state.select(*keys, "scale", "q", "ahead", F.posexplode("path").alias("_k", "p"))
    future = future.select(
        *keys, (F.col("_k") + 1).alias("k"), F.get("ahead", F.col("_k"))["pos"].alias("pos"), (F.col("p") * F.col("scale")).alias("mean"),
        ((F.col("p") + low) * F.col("scale")).alias("lower"), ((F.col("p") + high) * F.col("scale")).alias("upper"),
    )
    scales = rows.groupBy(*keys).agg(F.max("scale").alias("scale"))
    hist = fitted.join(bands, list(keys)).join(scales, list(keys))
    s = F.col("scale")
    history = hist.select(*keys, "pos", "ts", (F.col("target") * s).alias("y"), (F.col("predicted") * s).alias("fit"), ((F.col("predicted") + low) * s).alias("fit_lower"), ((F.col("predicted") + high) * s).alias("fit_upper"))
    return assemble(history, future, "GBT", h, step, keys)
