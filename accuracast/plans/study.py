"""The evaluation study end to end, and the saved run that reports read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accuracast import registry
from accuracast.operators import association as asc
from accuracast.operators import cleaning as cl
from accuracast.operators import clustering as clu
from accuracast.operators import features as ft
from accuracast.operators import featurespace as fs
from accuracast.operators import meta as mm
from accuracast.operators import metrics as mt
from accuracast.operators import predictors as pr
from accuracast.operators import ranking as rk
from accuracast.operators import windows as win
from accuracast.operators.catalogue import feature_catalogue
from accuracast.operators.forecasters import forecast_panel
from accuracast.session import new_path

UNIT = ["split", "series_id"]
PREDICTORS = ["insample", "backtest_k", "rolling_cv", "sim_cv", "cl_kmeans_cv", "cl_hier_cv", "cl_density_cv", "meta_learning"]


@dataclass
class Run:
    """Named tables of a study. Each is written once, partitioned by split, and read by the rest."""

    spark: SparkSession
    path: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        target = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy("split") if "split" in df.columns else writer).parquet(target)
        self.tables[name] = self.spark.read.parquet(target)
        return self.tables[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self.tables[name]

    def of(self, name: str, split: str) -> DataFrame:
        """Rows of one split, the split column dropped."""
        return self[name].where(F.col("split") == split).drop("split")


def start_run(spark: SparkSession, name: str = "study") -> Run:
    return Run(spark, new_path(spark, name))


def study_windows(run: Run, panel: DataFrame, n: int, h: int, **layout) -> None:
    run.save("windows", win.window_series(win.train_val_test(panel, n, h, **layout)))
    run.save("past", run["windows"].where("part = 'past'").select(*UNIT, "source_id", "pos", "ts", "y"))


def study_scores(run: Run, model: str, h: int, metrics: Sequence[str], **params) -> None:
    fc = forecast_panel(run["past"], model, h, UNIT, **params).where(F.col("mean").isNotNull())
    run.save("forecast", fc.select(*UNIT, "model_key", "pos", "mean", "lower", "upper"))
    run.save("fc_eval", mt.evaluate_forecasts(run["windows"], run["forecast"], UNIT, metrics))


def study_ranking(run: Run) -> None:
    """pred and fc_eval → pred_eval, composite scores, best methods and the judgement on test."""
    run.save("pred_eval", rk.pred_eval(run["pred"], run["fc_eval"].where("split <> 'train'")))
    run.save("scores", rk.composite_score(run["pred_eval"]))
    run.save("best_method", rk.best_method(run["scores"]))
    run.save("real_ranks", rk.real_ranks(run["scores"]))
    run.save("best_method_eval", rk.best_method_eval(run["neighbors_test_val"], run.of("best_method", "val"), run.of("best_method", "test")))
    p = run["scores"].select("predictor").distinct().count()
    run.save("rank_deviation", rk.rank_deviation_neighbor_avg(run["neighbors_test_val"], run.of("real_ranks", "val"), run.of("real_ranks", "test"), p))


def study_associations(run: Run, features: DataFrame) -> None:
    evals, scores = run["pred_eval"], run["fc_eval"]
    parts = [
        asc.assoc_features_vs_fc_eval(scores, features), asc.assoc_pred_eval_vs_features(evals, features),
        asc.assoc_pred_eval_vs_fc_eval(evals, scores.where("split <> 'train'")), asc.assoc_grouping_sets(evals, scores),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    run.save("assoc", asc.by_pvalue(out))
    run.save("mann_whitney", asc.by_pvalue(asc.mann_whitney(evals)))


def by_split(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for split, df in frames.items():
        one = df.select(F.lit(split).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def run_study(
    panel: DataFrame, model: str = "gbt_panel", h: int = 26, n: int = 5, predictors: Sequence[str] = PREDICTORS, metrics: Sequence[str] = mt.ALL_METRICS,
    n_boot: int = pr.BOOTSTRAPS, model_params: dict | None = None, space_features: Sequence[str] | None = None, trees: int = 100,
    cluster_counts: Sequence[int] | None = None, density_precision: float = clu.PRECISION, layout: dict | None = None,
) -> Run:
    """Windows → forecasts → scores → features → predictors → ranking → associations.

    Only counts and scalars reach the driver. Every stage reads the tables of the stages before.
    """
    params = model_params or {}
    unknown = [p for p in predictors if p not in PREDICTORS and p not in registry.PREDICTORS]
    if unknown:
        raise ValueError(f"unknown predictors: {', '.join(unknown)}")
    run = start_run(panel.sparkSession)
    study_windows(run, panel, n, h, **(layout or {}))
    study_scores(run, model, h, metrics, **params)

    past = cl.leading_zeros_to_null(run["past"], UNIT)
    raw = feature_catalogue(past, UNIT) if space_features is None else ft.compute_features(past, space_features, UNIT)
    run.save("features_raw", raw)
    run.save("features", fs.apply_norm_features(ft.compute_features(run["past"], ft.feature_names("study"), UNIT)))
    space = fs.FeatureSpace(run.of("features_raw", "train"), ["series_id"])
    run.save("points", by_split({s: space.transform(run.of("features_raw", s)) for s in win.SPLITS}))

    n_train = run.of("points", "train").select("series_id").distinct().count()
    n_val = run.of("points", "val").select("series_id").distinct().count()
    train_points, train_eval = run.of("points", "train"), run.of("fc_eval", "train")
    clusters = {p: None for p in predictors if p.startswith("cl_")}
    for p in clusters:
        clusters[p] = run.save(f"clusters_{p}", clu.fit_clusters(p, train_points, n_train, cluster_counts, density_precision))
    # the train split ends before any horizon of val and test begins
    known = run.of("windows", "train").select("series_id", "pos", "ts", "y")
    bundle = mm.fit_meta_bundle(known, model, h, n, metrics=metrics, trees=trees, **params) if "meta_learning" in predictors else None

    parts, near = [], {}
    for split in ["val", "test"]:
        mine, points = run["past"].where(F.col("split") == split), run.of("points", split)
        got = {}
        if "insample" in predictors:
            got["insample"] = pr.pred_insample(mine, model, h, UNIT, n_boot, metrics=metrics, **params).drop("split")
        if "backtest_k" in predictors:
            got["backtest_k"] = pr.pred_backtest(mine, model, h, UNIT, n_boot, metrics=metrics, **params).drop("split")
        if "rolling_cv" in predictors:
            got["rolling_cv"] = pr.pred_rolling_cv(mine, model, h, UNIT, metrics=metrics, **params).drop("split")
        if "sim_cv" in predictors:
            near[split] = fs.nearest_series(train_points, points, k=pr.neighbour_count(n_train))
            got["sim_cv"] = pr.pred_nearest(near[split], train_eval)
        for p, labels in clusters.items():
            got[p] = pr.pred_cluster(labels, clu.assign_cluster(points, train_points, labels), train_eval)
        if bundle is not None:
            got["meta_learning"] = mm.predict_meta(bundle, run.of("past", split), h)
        targets = run.of("past", split).select("series_id").distinct()
        got |= {p: registry.PREDICTORS[p].build(targets, train_eval) for p in predictors if p not in PREDICTORS}
        for name, df in got.items():
            parts.append(df.select(F.lit(split).alias("split"), F.lit(name).alias("predictor"), "series_id", "metric", "mean", "lower", "upper"))
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    run.save("pred", pred)
    run.save("neighbors_test_val", fs.nearest_series(run.of("points", "val"), run.of("points", "test"), k=n_val))
    study_ranking(run)
    study_associations(run, run["features"])
    return run
