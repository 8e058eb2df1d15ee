"""Report tables: the data behind distribution, ranking and association plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.functions.columns import finite
from accuracast.functions.scale import exact_quantiles

BINS = 40
VIOLIN = {"minimum": 0.0, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "maximum": 1.0}
PERCENT = "%.2f%%"


def histogram(df: DataFrame, keys: Sequence[str], value: str = "value", bins: int = BINS) -> DataFrame:
    """Equal-width counts per group over its own range; empty bins included."""
    keys = list(keys)
    known = df.where(finite(value).isNotNull())
    box = known.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = F.col("hi") - F.col("lo")
    rows = known.join(box, keys)
    slot = F.when(span > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / span * bins).cast("int"))).otherwise(0)
    counts = rows.groupBy(*keys, slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = box.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*keys, "bin"], "left")
    width = span / bins
    return out.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def best_method_dist(actual: DataFrame, predicted: DataFrame, predictors: DataFrame) -> DataFrame:
    """How often each predictor is best and is predicted to be; all predictors appear."""
    a = actual.groupBy("predictor").agg(F.count(F.lit(1)).alias("n_actual"))
    p = predicted.groupBy("predictor").agg(F.count(F.lit(1)).alias("n_predicted"))
    out = predictors.select("predictor").distinct().join(a, "predictor", "left").join(p, "predictor", "left").fillna(0, ["n_actual", "n_predicted"])
    totals = out.agg(F.sum("n_actual").alias("a"), F.sum("n_predicted").alias("p")).select(F.struct("a", "p")).scalar()
    out = out.withColumn("_t", totals)
    share = lambda n, t: 100.0 * F.col(n) / F.when(F.col(f"_t.{t}") > 0, F.col(f"_t.{t}"))
    return out.select("predictor", "n_actual", "n_predicted", share("n_actual", "a").alias("share_actual"), share("n_predicted", "p").alias("share_predicted"))


def clamp_deviation(deviations: DataFrame, n_predictors: int) -> DataFrame:
    top = float(n_predictors - 1)
    return deviations.withColumn("deviation", F.greatest(F.lit(-top), F.least(F.lit(top), F.col("deviation"))))


def violin_summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count and quantiles of a value per group."""
    return exact_quantiles(df.withColumn(value, finite(value)), keys, value, VIOLIN)


def averaged_per_series(evals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over metrics per series before the distribution is taken."""
    return evals.where(finite("value").isNotNull()).groupBy(*keys, "series_id").agg(F.avg("value").alias("value"))


def quadrant_table(evals: DataFrame, x_threshold: float = 0.5) -> DataFrame:
    """Reciprocal rank against margin with the default thresholds, and the quadrant of every series."""
    y = exact_quantiles(evals.withColumn("_all", F.lit(1)), ["_all"], "margin", {"m": 0.5}).select("m").scalar()
    rows = evals.withColumn("y_threshold", y).withColumn("x_threshold", F.lit(x_threshold))
    right, up = F.col("reciprocal_rank") >= F.col("x_threshold"), F.col("margin") >= F.col("y_threshold")
    quadrant = F.concat(F.when(up, "high").otherwise("low"), F.lit("_"), F.when(right, "right").otherwise("left"))
    return rows.select("series_id", "reciprocal_rank", "margin", F.col("top1_agree").alias("correct"), "x_threshold", "y_threshold", F.when(F.col("margin").isNotNull(), quadrant).alias("quadrant"))


def assoc_matrix(assoc: DataFrame, rows: Sequence[str], column: str, names: Sequence[str], value: str = "rho") -> DataFrame:
    """Correlation (or p) matrix in one of the layouts: any key columns against one column."""
    return assoc.groupBy(*rows).pivot(column, list(names)).agg(F.first(value))


def accuracy_table(pred: DataFrame) -> DataFrame:
    """Score and metric rows as percentages, blocks and rows in report order."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate(["predictability", "rpa", "rqa", "mia", "effectiveness", "bds", "ljb", "runs"]) for x in (m, i)])
    block = F.when(F.col("metric").isin("predictability", "rpa", "rqa", "mia"), "Predictability").otherwise("Effectiveness")
    pct = lambda c: F.format_string(PERCENT, F.bround(F.col(c) * 100, 2))
    return pred.select(
        "split", "predictor", "series_id", block.alias("block"), F.try_element_at(order, F.col("metric")).alias("position"), "metric",
        *[pct(c).alias(c) for c in ["mean", "lower", "upper"]],
    )
