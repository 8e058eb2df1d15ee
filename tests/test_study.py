"""Neighbours, clusters, predictors, meta-learning against brute force."""

import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accuracast.operators import association as asc
from accuracast.operators import clustering as clu
from accuracast.operators import featurespace as fs
from accuracast.operators import meta as mm
from accuracast.operators import predictors as pr
from accuracast.operators import ranking as rk
from accuracast.session import new_path

RNG = np.random.default_rng(11)


def long_points(spark, x, prefix="s"):
    rows = [(f"{prefix}{i:04d}", f"pc{j + 1}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "series_id string, feature string, value double")


@pytest.mark.parametrize("block", [7, 20000])
def test_knn_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(fs, "BLOCK_ROWS", block)
    x = RNG.normal(size=(60, 3)).round(1)
    x[:20] = x[0]  # a third of the points are copies
    v = clu.vectors(long_points(spark, x))
    got = fs.knn(v, v, 5).orderBy("target_id", "rank").toPandas()
    ids = np.array([f"s{i:04d}" for i in range(60)])
    for i, (t, g) in enumerate(got.groupby("target_id")):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = np.lexsort((ids, d))[:5]
        assert g.train_id.tolist() == ids[order].tolist() and g.distance.to_numpy() == pytest.approx(d[order])


def test_elbow_cuts_the_list(spark):
    rows = [("t", f"n{i}", i + 1, d) for i, d in enumerate([1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 9.0, 9.1, 9.2])]
    n = spark.createDataFrame(rows, "target_id string, train_id string, rank int, distance double")
    assert fs.slope_cut(n, 9, min_k=2).count() == 6
    assert fs.slope_cut(n, 9, min_k=8).count() == 8


def test_components_equal_svd(spark):
    x = RNG.normal(size=(40, 6)) @ np.diag([9, 5, 3, 1, 0.5, 0.1])
    space = fs.FeatureSpace(long_points(spark, x), ["series_id"])
    got = space.transform(long_points(spark, x)).groupBy("series_id").pivot("feature").agg(F.first("value")).orderBy("series_id").toPandas()[["pc1", "pc2", "pc3"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    z = (z - np.median(z, 0)) / (np.quantile(z, 0.75, 0) - np.quantile(z, 0.25, 0))
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    p = (u * s)[:, :3]
    p = (p - p.min(0)) / (p.max(0) - p.min(0))
    for j in range(3):
        assert min(np.abs(got[:, j] - p[:, j]).max(), np.abs(got[:, j] - (1 - p[:, j])).max()) < 1e-8


def brute_dbscan(x, eps, k):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= k
    comp = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and comp[i] < 0:
            comp[i], todo = i, [i]
            while todo:
                for j in np.nonzero(near[todo.pop()] & core & (comp < 0))[0]:
                    comp[j] = i
                    todo.append(j)
    for i in range(len(x)):
        if not core[i] and (near[i] & core).any():
            comp[i] = comp[np.nonzero(near[i] & core)[0]].min()
    names = {v: n for n, v in enumerate(sorted(set(comp[comp >= 0])))}
    return [names.get(v, -1) for v in comp]


@pytest.mark.parametrize("eps,k", [(0.25, 4), (0.12, 3), (2.0, 5), (0.01, 5)])
def test_density_clusters(spark, eps, k):
    x = np.concatenate([RNG.normal(c, 0.12, (25, 3)) for c in (0, 1, 2)] + [np.full((20, 3), 0.5), RNG.uniform(-1, 3, (10, 3))]).round(3)
    got = clu.cluster_density(long_points(spark, x), eps, k).orderBy("series_id").toPandas()
    assert got.label.tolist() == brute_dbscan(x, eps, k)


def test_cluster_choice_and_assignment(spark):
    x = np.concatenate([RNG.normal(c, 0.02, (15, 3)) for c in (0, 1, 2)])
    p = long_points(spark, x)
    labels = clu.fit_clusters("cl_kmeans_cv", p, 45, [2, 3, 4])
    assert labels.select("label").distinct().count() == 3
    near = clu.assign_cluster(long_points(spark, [[0, 0, 0], [2, 2, 2]], "t"), p, labels).orderBy("series_id").collect()
    assert near[0].label != near[1].label
    assert clu.cluster_range(20) == list(range(2, 19)) and clu.cluster_range(125) == list(range(2, 13))


def test_moving_blocks_stay_together(spark):
    d = spark.range(50).select(pr.draw_indices(F.lit(12), F.col("id"), 0, 4).alias("i")).collect()
    for r in d:
        assert len(r.i) == 12 and all(0 <= v < 12 for v in r.i)
        assert all(r.i[j + 1] == r.i[j] + 1 for j in range(11) if (j + 1) % 4)


def test_partial_correlation_matches_regression(spark):
    n = 60
    z = RNG.normal(size=(n, 3))
    y = z[:, 0] + 0.5 * z[:, 1] + RNG.normal(size=n)
    rows = [("g", f"s{i}", f"f{j}", float(z[i, j]), float(y[i])) for i in range(n) for j in range(3)]
    df = spark.createDataFrame(rows, "g string, series_id string, feature string, x double, y double")
    got = {r.feature: r.rho for r in asc.partial_spearman(df, ["g"]).collect()}
    r = pd.DataFrame(z).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    for j in range(3):
        d = np.column_stack([np.ones(n), np.delete(r[0], j, 1)])
        res = [v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in (r[0][:, j], r[1])]
        assert got[f"f{j}"] == pytest.approx(np.corrcoef(*res)[0, 1], abs=1e-6)


def test_partial_correlation_of_constant_columns(spark):
    """a constant column has no rank correlation; rounding of large uncentred sums made one up."""
    n = 125
    z = RNG.normal(size=(n, 2))
    rows = [(g, f"s{i}", f"f{j}", float(x), 7.0 if g == "y" else float(z[i, 0] + i)) for g in ("f", "y", "n") for i in range(n) for j, x in enumerate([*z[i], 0.0 if g == "f" else float(i * i % 97)])]
    df = spark.createDataFrame(rows, "g string, series_id string, feature string, x double, y double")
    got = {(r.g, r.feature): r for r in asc.partial_spearman(df, ["g"]).collect()}
    assert {(g, r.constants) for (g, _), r in got.items()} == {("f", 1), ("y", 1), ("n", 0)}
    assert got["f", "f2"].rho == 0.0 and all(got["y", f"f{j}"].rho == 0.0 for j in range(3))
    r = pd.DataFrame(z).rank().to_numpy(), pd.Series([z[i, 0] + i for i in range(n)]).rank().to_numpy()
    for j in range(2):  # the constant control changes nothing
        d = np.column_stack([np.ones(n), r[0][:, 1 - j]])
        res = [v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in (r[0][:, j], r[1])]
        assert got["f", f"f{j}"].rho == pytest.approx(np.corrcoef(*res)[0, 1], abs=1e-6)


def test_composite_prefers_name_on_ties(spark):
    rows = [("test", p, "abs_diff", "rpa", "a", v) for p, v in [("x", 0.1), ("b", 0.1), ("c", 0.5)]]
    e = spark.createDataFrame(rows, "split string, predictor string, pred_metric string, metric string, series_id string, value double")
    assert rk.best_method(rk.composite_score(e)).first().predictor == "b"


def test_interval_score(spark):
    r = spark.range(1).select(rk.interval_score(F.lit(0.5), F.lit(0.8), F.lit(0.6)).alias("a"), rk.interval_score(F.lit(0.7), F.lit(0.8), F.lit(0.6)).alias("b")).first()
    assert r.a == pytest.approx(0.2 + 40 * 0.1) and r.b == pytest.approx(0.2)


def test_meta_models(spark, make):
    series = {f"s{i}": RNG.normal(10 + i, 1 + i % 3, 90) for i in range(8)}
    panel = make(series)
    dynamic = ["acf_lag1", "skewness", "spikiness"]
    rows = mm.meta_training_set(panel, "meanfill", 6, 3, ["rpa", "mia"], dynamic)
    assert rows.count() == 24
    static = rows.groupBy("series_id").agg(F.count_distinct("full_series_mean").alias("k")).collect()
    assert all(r.k == 1 for r in static)
    folds = mm.with_folds(rows, 5).groupBy("series_id").agg(F.count_distinct("fold").alias("k")).collect()
    assert all(r.k == 1 for r in folds)
    bundle = mm.fit_meta_model(rows, ["rpa", "mia"], mm.meta_names()[0], dynamic, 6, trees=5)
    path = new_path(spark, "bundle")
    bundle.save(path)
    a = mm.predict_meta(bundle, panel, 6).orderBy("series_id", "metric").collect()
    b = mm.predict_meta(mm.MetaBundle.load(spark, path), panel, 6).orderBy("series_id", "metric").collect()
    assert a == b and len(a) == 8 * 3 and all(0 <= r.lower <= r.upper <= 1 for r in a)
    inside = mm.ood_flags(mm.long_features(mm.target_features(bundle, panel, 6), dynamic, ["series_id"]), bundle.stats)
    far = panel.withColumn("y", F.when(F.col("pos") == 5, 1e6).otherwise(F.col("y")))
    outside = mm.ood_flags(mm.long_features(mm.target_features(bundle, far, 6), dynamic, ["series_id"]), bundle.stats)
    assert outside.agg(F.min("n_out")).first()[0] >= 1 and inside.count() == 8
    warned = mm.predict_meta(bundle, far, 6, warn=True).collect()
    assert len(warned) == 8 * 3 and all(r.n_out >= 1 and "full_series_std" in r.unfamiliar.split(",") and r.n_out == len(r.unfamiliar.split(",")) for r in warned)
    known = mm.predict_meta(bundle, panel, 6, warn=True).drop("n_out", "unfamiliar").orderBy("series_id", "metric").collect()
    assert known == a


def test_python_feature(make):
    from accuracast.operators.features import features_wide
    from accuracast.registry import register_python_feature

    register_python_feature("spread", lambda y: y.max() - y.min())
    register_python_feature("broken", lambda y: 1 / 0)
    r = features_wide(make({"a": [1, 5, 3]}), ["spread", "broken"]).first()
    assert r.spread == 4.0 and r.broken is None


def test_registered_study_is_whole(spark, monkeypatch):
    """the query asked for two numbers of clusters, and for a part of the windows, replicates, trees, features and metrics."""
    import __spark_entry__ as entry
    from accuracast.plans import report_q as rq
    from accuracast.plans import study as st

    query, operator, calls = entry.queries()["run_study"], inspect.signature(st.run_study), []
    scores = spark.createDataFrame([("val", "a", "x", 0.25), ("val", "a", "y", 0.5), ("test", "b", "x", 1.0)], "split string, predictor string, series_id string, score double")
    monkeypatch.setattr(rq, "panel", lambda spark, d, name: name)
    monkeypatch.setattr(st, "run_study", lambda *args, **kwargs: calls.append(operator.bind(*args, **kwargs).arguments) or {"scores": scores})
    assert sorted(map(tuple, query(spark, "").collect())) == [("test", "b", 1, 1.0), ("val", "a", 2, 0.375)]
    given, = calls
    whole = {k: p.default for k, p in operator.parameters.items() if k not in ("panel", "model")}
    assert {k: given.get(k, v) for k, v in whole.items()} == whole

    # seven points: every candidate from two clusters up is fitted
    fit, asked = clu.cluster_kmeans, []
    monkeypatch.setattr(clu, "cluster_kmeans", lambda points, k: asked.append(k) or fit(points, k))
    labels = clu.fit_clusters("cl_kmeans_cv", long_points(spark, [[i, i * i % 7, 0.5 * i] for i in range(7)]), 7, given.get("cluster_counts"))
    assert asked == [2, 3, 4, 5] and labels.count() == 7
