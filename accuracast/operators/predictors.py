"""Estimating the accuracy of a forecast before the actuals arrive.

Every predictor returns ``pred``: keys, metric, mean, lower, upper, rounded to four places.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accuracast.functions.columns import ID
from accuracast.functions.scale import exact_quantiles
from accuracast.operators.cleaning import holdout_split, uniform_hash
from accuracast.operators.forecasters import forecast_panel
from accuracast.operators.metrics import ALL_METRICS, build_units, insample_units, score_units, with_scale
from accuracast.operators.windows import split_windows
from accuracast.registry import register_predictor

BOOTSTRAPS = 500
PER_TASK = 25
TAIL = 0.025
MIN_POINTS = 4


def draw_indices(n: Column, b: Column, seed: int, block: int | None) -> Column:
    """n positions drawn with replacement, single or in moving blocks, for replicate b."""
    last = F.greatest(n - 1, F.lit(0)).cast("int")
    if block is None or block <= 1:
        return F.transform(F.sequence(F.lit(0), last), lambda i: (uniform_hash(seed, b, i) % n).cast("int"))
    starts = lambda i: (uniform_hash(seed, b, F.floor(i / block)) % F.greatest(n - block + 1, F.lit(1))).cast("int")
    single = F.transform(F.sequence(F.lit(0), last), lambda i: (uniform_hash(seed, b, i) % n).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: starts(i) + (i % block).cast("int"))
    return F.when(n >= block, blocks).otherwise(single)


def replicates(units: DataFrame, n_boot: int, seed: int, block: int | None, resample_past: bool, keys: Sequence[str]) -> DataFrame:
    """One row per unit and bootstrap replicate, horizon arrays resampled together.

    A unit is exchanged once per ``PER_TASK`` replicates, which are made and scored where that copy lands, so the
    work of one long unit spreads over tasks. A past that stays as it is gives its scale once per unit, and only its
    largest value travels along.
    """
    units = units.where(F.size("y") >= MIN_POINTS)
    kept = [] if resample_past else ["past", "scale"]
    if not resample_past:
        units = with_scale(units).withColumn("past", F.array(F.array_max("past")))
    first = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(PER_TASK))).alias("_b")
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.select(*keys, *kept, "y", "f", "lo", "hi", first).repartition(tasks, *keys, "_b")
    rows = rows.withColumn("b", F.explode(F.sequence("_b", F.least(F.col("_b") + (PER_TASK - 1), F.lit(n_boot - 1)))))
    rows = rows.withColumn("_i", draw_indices(F.size("y"), F.col("b"), seed, block))
    take = lambda name: F.transform("_i", lambda j: F.get(F.col(name), j)).alias(name)
    out = rows.select(*keys, "b", *kept, *[take(x) for x in ["y", "f", "lo", "hi"]])
    return out.withColumn("past", F.col("y")) if resample_past else out


def bootstrap_metrics(
    units: DataFrame, n_boot: int = BOOTSTRAPS, seed: int = 0, block: int | None = None, resample_past: bool = False,
    keys: Sequence[str] = ID, metrics: Sequence[str] = ALL_METRICS,
) -> DataFrame:
    """Percentile interval of every metric: keys, metric, lower, upper."""
    scored = score_units(replicates(units, n_boot, seed, block, resample_past, keys), [*keys, "b"], metrics)
    wide = scored.groupBy(*keys).agg(*[F.percentile(m, [TAIL, 1 - TAIL]).alias(m) for m in metrics])
    long = wide.unpivot(list(keys), list(metrics), "metric", "q")
    return long.select(*keys, "metric", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))


NUDGE = 1e-9


def rounded(pred: DataFrame) -> DataFrame:
    """Four places. Quantiles between four-place values often sit on a tie; the nudge settles it upwards."""
    return pred.withColumns({x: F.bround(F.col(x) + NUDGE, 4) for x in ["mean", "lower", "upper"]})


def with_interval(units: DataFrame, n_boot: int, seed: int, block: int | None, resample_past: bool, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Point estimate with bootstrap bounds, or the point itself when there is nothing to resample."""
    point = score_units(units, keys, metrics).unpivot(list(keys), list(metrics), "metric", "mean").where(F.col("mean").isNotNull())
    if n_boot <= 0:
        return rounded(point.withColumns({"lower": F.col("mean"), "upper": F.col("mean")}))
    boot = bootstrap_metrics(units, n_boot, seed, block, resample_past, keys, metrics)
    return rounded(point.join(boot, [*keys, "metric"], "left").withColumns({"lower": F.coalesce("lower", "mean"), "upper": F.coalesce("upper", "mean")}))


def whole_series_only(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A predictor that misses a value for a series gives nothing for that series."""
    bad = F.max((F.col("mean").isNull() | F.col("lower").isNull() | F.col("upper").isNull()).cast("int")).over(Window.partitionBy(*keys))
    return pred.withColumn("_bad", bad).where("_bad = 0").drop("_bad")


@register_predictor("insample")
def pred_insample(past: DataFrame, model: str, h: int, keys: Sequence[str] = ID, n_boot: int = BOOTSTRAPS, seed: int = 0, block: int | None = None, metrics=ALL_METRICS, **params) -> DataFrame:
    """Fit quality on the history itself."""
    units = insample_units(forecast_panel(past, model, h, keys, **params), keys)
    return with_interval(units, n_boot, seed, block, True, keys, metrics)


@register_predictor("backtest_k")
def pred_backtest(past: DataFrame, model: str, h: int, keys: Sequence[str] = ID, n_boot: int = BOOTSTRAPS, seed: int = 0, block: int | None = None, metrics=ALL_METRICS, **params) -> DataFrame:
    """Refit without the last h points and score on them."""
    rows = holdout_split(past, h, keys)
    fc = forecast_panel(rows.where("part = 'past'").drop("part"), model, h, keys, **params)
    return whole_series_only(with_interval(build_units(rows, fc, keys), n_boot, seed, block, False, keys, metrics), keys)


def cv_aggregate(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and 2.5 / 97.5 % quantiles of wide scores over the windows of a series (a handful)."""
    aggs = [F.struct(F.avg(m).alias("mean"), F.percentile(m, [TAIL, 1 - TAIL]).alias("q"), F.bool_or(F.col(m).isNull()).alias("gap")).alias(m) for m in metrics]
    long = scores.groupBy(*keys).agg(*aggs).unpivot(list(keys), list(metrics), "metric", "s")
    out = long.select(*keys, "metric", F.when(~F.col("s.gap"), F.col("s.mean")).alias("mean"), F.get("s.q", F.lit(0)).alias("lower"), F.get("s.q", F.lit(1)).alias("upper"))
    return whole_series_only(rounded(out), keys)


@register_predictor("rolling_cv")
def pred_rolling_cv(past: DataFrame, model: str, h: int, keys: Sequence[str] = ID, n: int = 5, metrics=ALL_METRICS, **params) -> DataFrame:
    """Mean score over overlapping windows of the history."""
    windows = split_windows(past, n, h, keys=keys)
    wk = [*keys, "window_id"]
    fc = forecast_panel(windows.where("part = 'past'").drop("part"), model, h, wk, **params)
    return cv_aggregate(score_units(build_units(windows, fc, wk), wk, metrics), keys, metrics)


def neighbour_count(n_series: int) -> int:
    return max(4, min(30, math.ceil(0.1 * n_series)))


@register_predictor("sim_cv")
def pred_nearest(neighbors: DataFrame, train_eval: DataFrame) -> DataFrame:
    """Scores of the nearest training series; at most 30 rows per target and metric."""
    got = neighbors.join(train_eval.select(F.col("series_id").alias("train_id"), "metric", "value"), "train_id")
    out = got.groupBy(F.col("target_id").alias("series_id"), "metric").agg(F.avg("value").alias("mean"), F.percentile("value", [TAIL, 1 - TAIL]).alias("q"))
    return rounded(out.select("series_id", "metric", "mean", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper")))


@register_predictor("cl")
def pred_cluster(clusters: DataFrame, assigned: DataFrame, train_eval: DataFrame) -> DataFrame:
    """Scores of all members of the cluster a target falls into.

    Members are summarised once per (cluster, metric), whatever the cluster size, and targets then
    look the summary up.
    """
    members = clusters.select("series_id", "label").join(train_eval, "series_id").select("label", "metric", "value")
    q = exact_quantiles(members, ["label", "metric"], "value", {"lower": TAIL, "upper": 1 - TAIL})
    m = members.groupBy("label", "metric").agg(F.avg("value").alias("mean"))
    summary = m.join(q.select("label", "metric", "lower", "upper"), ["label", "metric"])
    return rounded(assigned.select("series_id", "label").join(summary, "label").select("series_id", "metric", "mean", "lower", "upper"))


def rank_predictors(pred: DataFrame, actual: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Blend of error rank and interval-miss rank per target (half each); lowest is best.

    ``pred``: target columns ``by``, predictor, metric, mean, lower, upper, already averaged over the
    comparison series; ``actual``: by, metric, value.
    """
    by = list(by)
    rows = pred.where(F.col("metric").isin(*metrics)).join(actual.select(*by, "metric", F.col("value").alias("a")), [*by, "metric"])
    low, high = F.least("lower", "upper"), F.greatest("lower", "upper")
    known = F.col("lower").isNotNull() & F.col("upper").isNotNull() & F.col("a").isNotNull()
    miss = F.when(~known, 1.0).when((F.col("a") >= low) & (F.col("a") <= high), 0.0).otherwise(1.0)
    err = rows.groupBy(*by, "predictor").agg(F.bround(F.avg(F.abs(F.col("mean") - F.col("a"))), 12).alias("mean_error"), F.avg(miss).alias("interval_miss_rate"))

    def avg_rank(x):
        return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0

    ranked = err.withColumns({"rank_mean": avg_rank("mean_error"), "rank_interval": avg_rank("interval_miss_rate")})
    return ranked.withColumn("combined_rank", 0.5 * F.col("rank_mean") + 0.5 * F.col("rank_interval"))


@register_predictor("best_method")
def pred_best_method(neighbors: DataFrame, neighbour_pred: DataFrame, target_eval: DataFrame, target_pred: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Run every predictor on the nearest series, keep the one that ranks best, apply it to the target.

    neighbors: target_id, train_id; neighbour_pred: predictor, series_id, metric, mean, lower, upper of
    the training series; target_eval: series_id, metric, value of the neighbours' realised scores per
    target; target_pred: every predictor on the targets.
    """
    near = neighbors.join(neighbour_pred.withColumnRenamed("series_id", "train_id"), "train_id")
    mean = near.groupBy("target_id", "predictor", "metric").agg(*[F.avg(x).alias(x) for x in ["mean", "lower", "upper"]])
    ranked = rank_predictors(mean.withColumnRenamed("target_id", "series_id"), target_eval, metrics, ["series_id"])
    best = ranked.groupBy("series_id").agg(F.min_by("predictor", F.struct("combined_rank", "predictor")).alias("predictor"))
    return target_pred.join(best, ["series_id", "predictor"])
