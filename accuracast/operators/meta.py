"""Learning forecast accuracy from series features: training windows, models, predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accuracast.functions.columns import finite
from accuracast.functions.scale import exact_quantiles
from accuracast.operators import features as ft
from accuracast.operators import metrics as mt
from accuracast.operators.forecasters import forecast_panel
from accuracast.operators.windows import meta_windows
from accuracast.registry import METRICS
from accuracast.session import written

SEED = 42
MAX_FOLDS = 5
MIN_SAMPLES = 5
BAND = (0.05, 0.95)
SCORE_BAND = (0.8, 1.2)
OOD_BAND = (0.01, 0.99)
PARTS = [*mt.PREDICTABILITY, *mt.EFFECTIVENESS]


def meta_names() -> tuple[list[str], list[str]]:
    """(static, dynamic) features used for learning."""
    return ft.feature_names("meta_learning", True), ft.feature_names("meta_learning", False)


def meta_training_set(panel: DataFrame, model: str, h: int, n: int, metrics: Sequence[str] = PARTS, dynamic: Sequence[str] | None = None, **params) -> DataFrame:
    """One row per (series, window): static features of the series, dynamic ones of the window's
    history, horizon, and the realised scores."""
    static, default = meta_names()
    dynamic = list(dynamic) if dynamic is not None else default
    keys = ["series_id", "window_id"]
    w = meta_windows(panel, n, h)
    past = w.where("part = 'past'").select(*keys, "pos", "ts", "y")
    whole = ft.features_wide(panel, static)
    moving = ft.features_wide(past, dynamic, keys)
    fc = forecast_panel(past, model, h, keys, **params)
    scores = mt.score_units(mt.build_units(w, fc, keys), keys, metrics)
    return moving.join(whole, "series_id").join(scores, keys).withColumn("horizon", F.lit(float(h)))


def long_features(rows: DataFrame, names: Sequence[str], ids: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(ids), list(names), "feature", "value").withColumn("value", finite("value"))


def feature_stats(rows: DataFrame, names: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(feature, mean, std, q01, q99) of a training set."""
    long = long_features(rows, names, ids)
    g = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    q = exact_quantiles(long, ["feature"], "value", {"q01": OOD_BAND[0], "q99": OOD_BAND[1]})
    return g.join(q.select("feature", "q01", "q99"), "feature", "left")


def with_folds(rows: DataFrame, k: int) -> DataFrame:
    """Fold of a row by its series, so no series is in two folds and no global order is needed."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("series_id"), F.lit(k)))


def forest(names: Sequence[str], target: str, trees: int, depth: int) -> Pipeline:
    filled = [f"{n}_filled" for n in names]
    return Pipeline(stages=[
        Imputer(inputCols=list(names), outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="x"),
        RandomForestRegressor(featuresCol="x", labelCol=target, predictionCol="predicted", numTrees=trees, maxDepth=depth, seed=SEED),
    ])


def usable(rows: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns with at least one value; one aggregate row."""
    counts = rows.agg(*[F.count(finite(n)).alias(n) for n in names]).first()
    return [n for n in names if counts[n] > 0]


def group_kfold_r2(rows: DataFrame, names: Sequence[str], metrics: Sequence[str] = PARTS, trees: int = 100, depth: int = 10, folds: int = MAX_FOLDS) -> DataFrame:
    """(metric, fold, r2): fit on the other folds, score on this one."""
    n_series = rows.select("series_id").distinct().count()
    k = min(folds, n_series)
    data = written(with_folds(rows, k) if k >= 2 else rows.withColumn("fold", (F.pmod(F.xxhash64("series_id", "window_id"), F.lit(5)) == 0).cast("bigint")), "folds")
    judged = [0] if k == 1 else list(range(k))
    out = []
    for metric in metrics:
        known = data.where(F.col(metric).isNotNull())
        for fold in judged:
            held = F.col("fold") == (fold if k >= 2 else 1)
            train, test = known.where(~held), known.where(held)
            if train.limit(MIN_SAMPLES).count() < MIN_SAMPLES or test.isEmpty():
                continue
            scored = forest(usable(train, names), metric, trees, depth).fit(train).transform(test)
            out.append((metric, fold, float(RegressionEvaluator(labelCol=metric, predictionCol="predicted", metricName="r2").evaluate(scored))))
    return rows.sparkSession.createDataFrame(out, "metric string, fold int, r2 double")


@dataclass
class MetaBundle:
    """One fitted pipeline per metric with its residual band, and the training feature statistics."""

    models: dict[str, PipelineModel]
    bands: dict[str, tuple[float, float]]
    names: list[str]
    static: list[str]
    dynamic: list[str]
    stats: DataFrame
    horizon: int

    def save(self, path: str) -> None:
        spark = self.stats.sparkSession
        for metric, model in self.models.items():
            model.write().overwrite().save(f"{path}/model_{metric}")
        meta = [(m, *self.bands[m], self.names, self.static, self.dynamic, self.horizon) for m in self.models]
        spark.createDataFrame(meta, "metric string, lower double, upper double, names array<string>, static array<string>, dynamic array<string>, horizon int").write.mode("overwrite").parquet(f"{path}/meta")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MetaBundle:
        rows = spark.read.parquet(f"{path}/meta").collect()
        models = {r.metric: PipelineModel.load(f"{path}/model_{r.metric}") for r in rows}
        r0 = rows[0]
        return cls(models, {r.metric: (r.lower, r.upper) for r in rows}, r0.names, r0.static, r0.dynamic, spark.read.parquet(f"{path}/stats"), r0.horizon)

    def importances(self) -> list[tuple[str, str, float]]:
        return [(m, n, float(v)) for m, model in self.models.items() for n, v in zip(self.names, model.stages[-1].featureImportances.toArray())]


def fit_meta_model(rows: DataFrame, metrics: Sequence[str], static: Sequence[str], dynamic: Sequence[str], h: int, trees: int = 100, depth: int = 10) -> MetaBundle:
    """Forest per metric on all rows; the band is the 5 to 95 % range of its residuals."""
    rows = written(rows, "meta")
    names = usable(rows, [*static, *dynamic, "horizon"])
    models, bands = {}, {}
    for metric in metrics:
        known = rows.where(F.col(metric).isNotNull())
        if known.limit(MIN_SAMPLES).count() < MIN_SAMPLES:
            continue
        model = forest(names, metric, trees, depth).fit(known)
        res = model.transform(known).select(F.lit(1).alias("_all"), (F.col(metric) - F.col("predicted")).alias("e"))
        q = exact_quantiles(res, ["_all"], "e", {"lower": BAND[0], "upper": BAND[1]}).first()
        models[metric], bands[metric] = model, (q["lower"], q["upper"])
    stats = written(feature_stats(rows, names, ["series_id", "window_id"]), "stats")
    return MetaBundle(models, bands, names, list(static), list(dynamic), stats, h)


def fit_meta_bundle(panel: DataFrame, model: str, h: int, n: int, metrics: Sequence[str] = mt.ALL_METRICS, trees: int = 100, dynamic: Sequence[str] | None = None, **params) -> MetaBundle:
    parts = [m for m in PARTS if m in metrics]
    static, default = meta_names()
    dynamic = list(dynamic) if dynamic is not None else default
    rows = meta_training_set(panel, model, h, n, parts, dynamic, **params)
    return fit_meta_model(rows, parts, static, dynamic, h, trees)


def target_features(bundle: MetaBundle, past: DataFrame, h: int) -> DataFrame:
    return ft.features_wide(past, [*bundle.static, *bundle.dynamic]).withColumn("horizon", F.lit(float(h)))


def predict_meta(bundle: MetaBundle, past: DataFrame, h: int, warn: bool = False) -> DataFrame:
    """pred rows (series_id, metric, mean, lower, upper) of every metric and of the composite scores.

    With ``warn`` every row also carries n_out, the number of features outside the training 1 to 99 % range, and
    unfamiliar, their names joined by commas (empty: a series like those trained on).
    """
    feats = written(target_features(bundle, past, h), "features")
    parts = None
    for metric, model in bundle.models.items():
        low, high = bundle.bands[metric]
        p = model.transform(feats)
        values = [F.col("predicted"), F.col("predicted") + F.lit(low), F.col("predicted") + F.lit(high)]
        if METRICS[metric].tags.get("bounded_01"):
            values = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in values]
        one = p.select("series_id", F.lit(metric).alias("metric"), *[F.bround(v, 4).alias(n) for v, n in zip(values, ["mean", "lower", "upper"])])
        parts = one if parts is None else parts.unionAll(one)
    family = F.when(F.col("metric").isin(mt.PREDICTABILITY), "predictability").otherwise("effectiveness")
    score = parts.groupBy("series_id", family.alias("metric")).agg(F.avg("mean").alias("m")).select(
        "series_id", "metric", F.bround("m", 4).alias("mean"), F.bround(F.greatest(F.lit(0.0), F.col("m") * SCORE_BAND[0]), 4).alias("lower"),
        F.bround(F.least(F.lit(1.0), F.col("m") * SCORE_BAND[1]), 4).alias("upper"),
    )
    pred = parts.unionAll(score)
    if not warn:
        return pred
    flags = ood_flags(long_features(feats, bundle.names, ["series_id"]), bundle.stats)
    flags = flags.select("series_id", "n_out", F.col("features").alias("unfamiliar"))
    return pred.join(flags, "series_id", "left").fillna({"n_out": 0, "unfamiliar": ""})


def ood_flags(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(series_id, n_out, features): features outside the training 1 to 99 % range; long input."""
    rows = features.join(stats.select("feature", "q01", "q99"), "feature")
    out = (F.col("value") < F.col("q01")) | (F.col("value") > F.col("q99"))
    return rows.groupBy("series_id").agg(
        F.count(F.when(out, 1)).alias("n_out"), F.array_join(F.array_sort(F.collect_list(F.when(out, F.col("feature")))), ",").alias("features")
    )


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and xor of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("fingerprint"))
