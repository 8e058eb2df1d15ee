"""Scoring the predictors, ranking them per series, and judging the choice on new series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accuracast.functions.columns import avg_rank
from accuracast.functions.scale import exact_quantiles

MIS_ALPHA = 0.05
HIT_RANKS = [1, 3, 5]
X_THRESHOLD = 0.5
SERIES = ["split", "series_id"]


def abs_diff(true: Column, mean: Column) -> Column:
    return F.abs(true - mean)


def interval_score(true: Column, lower: Column, upper: Column, alpha: float = MIS_ALPHA) -> Column:
    """Width plus penalties for a miss; swapped bounds are put right."""
    lo, hi = F.least(lower, upper), F.greatest(lower, upper)
    value = (hi - lo) + (2.0 / alpha) * (F.greatest(lo - true, F.lit(0.0)) + F.greatest(true - hi, F.lit(0.0)))
    return F.when(lower.isNotNull() & upper.isNotNull() & true.isNotNull(), value)


def pred_eval(pred: DataFrame, fc_eval: DataFrame) -> DataFrame:
    """abs_diff and mis of every prediction that has an actual score."""
    rows = pred.join(fc_eval.select("split", "series_id", "metric", F.col("value").alias("true")), ["split", "series_id", "metric"])
    wide = rows.select(
        "split", "predictor", "metric", "series_id", abs_diff(F.col("true"), F.col("mean")).alias("abs_diff"),
        interval_score(F.col("true"), F.col("lower"), F.col("upper")).alias("mis"),
    )
    return wide.unpivot(["split", "predictor", "metric", "series_id"], ["abs_diff", "mis"], "pred_metric", "value")


def rank_with_ties(evals: DataFrame) -> DataFrame:
    """Average rank of the predictors per series, metric and predictor metric; lower values rank first."""
    keys = ["split", "series_id", "pred_metric", "metric"]
    return evals.where(F.col("value").isNotNull()).withColumn("rank", avg_rank(keys, "value"))


def utilities(ranks: DataFrame) -> DataFrame:
    """Ranks to [0, 1], 1 for the best; alone is 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy("split", "series_id", "pred_metric", "metric"))
    return ranks.withColumn("utility", F.when(n > 1, 1 - (F.col("rank") - 1) / (n - 1)).otherwise(1.0))


def composite_score(evals: DataFrame) -> DataFrame:
    """Mean utility over metrics, then over predictor metrics; -infinity for a predictor without values.

    Rounded to twelve places, so equal means tie whatever order they were summed in.
    """
    per = utilities(rank_with_ties(evals)).groupBy(*SERIES, "predictor", "pred_metric").agg(F.avg("utility").alias("u"))
    score = per.groupBy(*SERIES, "predictor").agg(F.avg("u").alias("score"))
    names = evals.select("split", "predictor").distinct()  # a handful of rows
    grid = evals.select(*SERIES).distinct().join(names, "split")
    return grid.join(score, [*SERIES, "predictor"], "left").withColumn("score", F.coalesce(F.bround("score", 12), F.lit(float("-inf"))))


def best_method(scores: DataFrame) -> DataFrame:
    """Predictor with the highest composite per series, ties to the first by name."""
    return scores.groupBy(*SERIES).agg(F.min_by("predictor", F.struct(-F.col("score"), "predictor")).alias("predictor"))


def real_ranks(scores: DataFrame) -> DataFrame:
    """Average rank of each predictor by composite score, 1 = best."""
    return scores.withColumn("real_rank", avg_rank(SERIES, "score", ascending=False))


def best_method_eval(neighbors: DataFrame, best_val: DataFrame, best_test: DataFrame) -> DataFrame:
    """Per test series: does the best method of its nearest validation series agree with its own?"""
    val = best_val.select(F.col("series_id").alias("train_id"), F.col("predictor").alias("near"))
    test = best_test.select(F.col("series_id").alias("target_id"), F.col("predictor").alias("actual"))
    rows = neighbors.join(test, "target_id").join(val, "train_id", "left")
    agree = F.coalesce(F.col("near") == F.col("actual"), F.lit(False))
    g = rows.groupBy(F.col("target_id").alias("series_id"), "actual").agg(
        F.bool_or((F.col("rank") == 1) & agree).alias("top1_agree"), F.min(F.when(agree, F.col("rank"))).alias("first_match_rank"),
        F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("dist1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("dist2"),
        *[F.bool_or((F.col("rank") <= k) & agree).alias(f"hit_at_{k}") for k in HIT_RANKS],
    )
    return g.withColumns({"reciprocal_rank": F.coalesce(1.0 / F.col("first_match_rank"), F.lit(0.0)), "margin": F.col("dist2") - F.col("dist1")})


def best_method_summary(evals: DataFrame) -> DataFrame:
    """Share of agreements, mean reciprocal rank, hits within k, median margin."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    one = evals.withColumn("_all", F.lit(1))
    q = exact_quantiles(one, ["_all"], "margin", {"median_margin": 0.5}).select("_all", "median_margin")
    g = one.groupBy("_all").agg(
        F.count(F.lit(1)).alias("n_test"), share("top1_agree").alias("top1_accuracy"), F.avg("reciprocal_rank").alias("mrr"),
        *[share(f"hit_at_{k}").alias(f"hit_at_{k}") for k in HIT_RANKS],
    )
    return g.join(q, "_all", "left").drop("_all")


def with_deviation(pred_ranks: DataFrame, real: DataFrame, default: Column) -> DataFrame:
    """Predicted less real rank for every (test series, predictor); absent predictions rank last."""
    rows = real.select("series_id", "predictor", "real_rank").join(pred_ranks, ["series_id", "predictor"], "left")
    return rows.withColumn("pred_rank", F.coalesce("pred_rank", default)).withColumn("deviation", F.col("pred_rank") - F.col("real_rank"))


def rank_deviation_first_position(neighbors: DataFrame, best_val: DataFrame, real_test: DataFrame, n_predictors: int) -> DataFrame:
    """Predicted rank of a method = first place in the neighbour list whose best method it is."""
    val = best_val.select(F.col("series_id").alias("train_id"), "predictor")
    first = neighbors.join(val, "train_id").groupBy(F.col("target_id").alias("series_id"), "predictor").agg(F.min("rank").cast("double").alias("pred_rank"))
    return with_deviation(first, real_test, F.lit(float(n_predictors)))


def rank_deviation_neighbor_avg(neighbors: DataFrame, real_val: DataFrame, real_test: DataFrame, n_predictors: int, weighted: bool = False, eps: float = 1e-9) -> DataFrame:
    """Predicted rank = mean of the neighbours' real ranks, by choice weighted by nearness."""
    names = real_test.select("predictor").distinct()
    listed = names.agg(F.collect_list("predictor")).scalar()  # a handful of names
    rows = neighbors.select("target_id", "train_id", "distance", F.explode(listed).alias("predictor"))
    val = real_val.select(F.col("series_id").alias("train_id"), "predictor", F.col("real_rank").alias("r"))
    rows = rows.join(val, ["train_id", "predictor"], "left").withColumn("r", F.coalesce("r", F.lit(float(n_predictors))))
    w = 1.0 / (eps + F.coalesce("distance", F.lit(0.0))) if weighted else F.lit(1.0)
    avg = rows.groupBy(F.col("target_id").alias("series_id"), "predictor").agg(F.bround(F.sum(w * F.col("r")) / F.sum(w), 12).alias("pred_rank"))
    return with_deviation(avg, real_test, F.lit(float(n_predictors)))


def deviation_histogram(deviations: DataFrame, n_predictors: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of integer deviations over the whole range -(P-1)..P-1, empty bins included."""
    top = n_predictors - 1
    counts = deviations.groupBy(*by, F.rint("deviation").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = deviations.select(*by).distinct() if by else deviations.sparkSession.range(1).select()
    grid = bins.withColumn("bin", F.explode(F.sequence(F.lit(-top), F.lit(top))))
    return grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def predicted_best(deviations: DataFrame) -> DataFrame:
    """Predictor with the lowest predicted rank, ties to the first by name."""
    return deviations.groupBy("series_id").agg(F.min_by("predictor", F.struct("pred_rank", "predictor")).alias("predictor"))
