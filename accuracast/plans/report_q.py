"""Queries on clusters, meta-learning, boosting, reports, extension points and the whole study."""

from __future__ import annotations

from pyspark.sql import functions as F

from accuracast.functions.columns import rnd
from accuracast.operators import boosting as gb
from accuracast.operators import clustering as clu
from accuracast.operators import features as ft
from accuracast.operators import featurespace as fs
from accuracast.operators import forecasters as fc
from accuracast.operators import meta as mm
from accuracast.operators import metrics as mt
from accuracast.operators import predictors as pr
from accuracast.operators import ranking as rk
from accuracast.operators import reports as rp
from accuracast.operators import windows as win
from accuracast.plans import study as st
from accuracast.plans.catalog import R, fragment, query, sql
from accuracast.plans.features_q import feature_fragments
from accuracast.plans.forecast_q import forecast_rows, held_out, meanfill_fragment, score_fragments
from accuracast.plans.panels_q import META_H, H
from accuracast.plans.ranking_q import METRICS, UNIT, P, base_run
from accuracast.sources.panels import panel

AXES = ["crossing_points", "linearity", "skewness"]
_IN = ", ".join(f"'{a}'" for a in AXES)

# ---- clusters over three features of the study windows, scaled to the training box --------------

fragment("pt_box", f"select feature, min(value) as lo, max(value) as hi from w_train where feature in ({_IN}) group by 1", "w_train")
for _s in ["train", "val", "test"]:
    fragment(f"pt_{_s}", f"select series_id, feature, (value - lo) / case when hi > lo then hi - lo else 1e0 end as value from w_{_s} join pt_box using (feature)", f"w_{_s}", "pt_box")


def points(spark, d, split="train"):
    run = base_run(spark, d)
    train = run.of("features", "train").where(F.col("feature").isin(AXES))
    mine = run.of("features", split).where(F.col("feature").isin(AXES))
    return fs.minmax_scale(mine, fs.minmax_stats(train))


# labellings with a known rule: k bands of the first axis
BANDS = [2, 3, 4, 5, 6]
fragment("bands", f"select cast(k as integer) as k, series_id, cast(least(k - 1, floor(value * k)) as integer) as label from pt_train, (select unnest({BANDS}) as k) where feature = 'linearity'", "pt_train")


def banded(spark, d):
    p = points(spark, d).where("feature = 'linearity'").withColumn("k", F.explode(F.array(*[F.lit(k) for k in BANDS])))
    return p.select("k", "series_id", F.least(F.col("k") - 1, F.floor(F.col("value") * F.col("k")).cast("int")).alias("label"))


fragment("q_centre", "select k, label, feature, avg(value) as c, count(*) as n, var_pop(value) * count(*) as s from bands join pt_train using (series_id) group by all", "bands", "pt_train")
fragment("q_sse", "select k, sum(s) as sse from q_centre group by 1", "q_centre")
fragment("q_spread", "select k, label, avg(d) as s from (select k, label, series_id, sqrt(sum((value - c) * (value - c))) as d from bands join pt_train using (series_id) join q_centre using (k, label, feature) group by all) group by all", "bands", "pt_train", "q_centre")
fragment(
    "q_db",
    """select k, avg(r) as db from (select a.k, a.label, max((s1.s + s2.s) / m) as r from (
      select a.k, a.label, b.label as label2, sqrt(sum((a.c - b.c) * (a.c - b.c))) as m from q_centre a join q_centre b on a.k = b.k and a.feature = b.feature and a.label <> b.label group by all) a
      join q_spread s1 on s1.k = a.k and s1.label = a.label join q_spread s2 on s2.k = a.k and s2.label = a.label2 group by all) group by 1""",
    "q_centre", "q_spread",
)
fragment("q_pair", "select a.series_id, b.series_id as other, sum((a.value - b.value) * (a.value - b.value)) as d2 from pt_train a join pt_train b using (feature) where a.series_id <> b.series_id group by all", "pt_train")
fragment(
    "q_sil",
    """select k, avg(case when na = 0 or na is null then 0e0 else (b - a) / greatest(a, b) end) as silhouette from (
      select k, series_id, min(case when own then m end) as a, min(case when own then n end) as na, min(case when not own then m end) as b from (
        select x.k, x.series_id, y.label = x.label as own, y.label, avg(d2) as m, count(*) as n from bands x join q_pair p on p.series_id = x.series_id join bands y on y.k = x.k and y.series_id = p.other group by all)
      group by all) group by 1""",
    "bands", "q_pair",
)
fragment("quality", "select k, sse, db, silhouette from q_sse join q_db using (k) join q_sil using (k)", "q_sse", "q_db", "q_sil")


@query("cluster_sse", sql(f"select k, {R('sse')} as sse from q_sse", "q_sse"))
def _(spark, d):
    return clu.cluster_sse(points(spark, d), banded(spark, d)).select("k", rnd("sse").alias("sse"))


@query("davies_bouldin", sql(f"select k, {R('db')} as db from q_db", "q_db"))
def _(spark, d):
    return clu.davies_bouldin(points(spark, d), banded(spark, d)).select("k", rnd("db").alias("db"))


@query("silhouette", sql(f"select k, {R('silhouette')} as silhouette from q_sil", "q_sil"))
def _(spark, d):
    return clu.silhouette(points(spark, d), banded(spark, d), BANDS).select("k", rnd("silhouette").alias("silhouette"))


@query(
    "select_best_k",
    sql("""select k_elbow, k_db, k_sil, k_avg, (select arg_min(k, struct_pack(d := abs(k - k_avg), nk := -k)) from quality) as best_k from (
      select *, cast(ceil((k_elbow + k_db + k_sil) / 3e0) as integer) as k_avg from (select arg_min(k, struct_pack(o := -o, k := k)) as k_elbow, arg_min(k, struct_pack(v := db, k := k)) as k_db, arg_min(k, struct_pack(v := -silhouette, k := k)) as k_sil from (
        select *, round_even(abs((x2 - x1) * (sse - y1) - (y2 - y1) * (k - x1)) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 9) as o
        from quality, (select min(k) as x1, arg_min(sse, k) as y1, max(k) as x2, arg_max(sse, k) as y2 from quality))))""", "quality"),
)
def _(spark, d):
    p, labels = points(spark, d), banded(spark, d)
    q = clu.cluster_sse(p, labels).join(clu.davies_bouldin(p, labels), "k").join(clu.silhouette(p, labels, BANDS), "k")
    return clu.select_best_k(q)


@query("cluster_kmeans")
def _(spark, d):
    p = points(spark, d)
    return clu.fit_clusters("cl_kmeans_cv", p, p.select("series_id").distinct().count(), counts=[3, 5, 7])


@query("cluster_hier")
def _(spark, d):
    p = points(spark, d)
    return clu.fit_clusters("cl_hier_cv", p, p.select("series_id").distinct().count(), counts=[3, 5, 7])


EPS, MIN_SAMPLES = 0.08, 5
fragment("ds_pt", f"select series_id, max(case when feature = '{AXES[0]}' then value end) as a, max(case when feature = '{AXES[1]}' then value end) as b, max(case when feature = '{AXES[2]}' then value end) as c from pt_train group by 1", "pt_train")
fragment("ds_near", f"select x.series_id as p, y.series_id as q from ds_pt x join ds_pt y on sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c)) <= {EPS}e0", "ds_pt")
fragment("ds_core", f"select p from ds_near group by 1 having count(*) >= {MIN_SAMPLES}", "ds_near")
fragment("ds_edge", "select p, q from ds_near where p in (select p from ds_core) and q in (select p from ds_core)", "ds_near", "ds_core")
fragment("ds_reach", "select p, q from ds_edge union select r.p, e.q from ds_reach r join ds_edge e on e.p = r.q", "ds_edge")
fragment("ds_comp", "select p, min(q) as comp from ds_reach group by 1", "ds_reach")
fragment("ds_label", "select comp, row_number() over (order by comp) - 1 as label from (select distinct comp from ds_comp)", "ds_comp")


@query(
    "cluster_density",
    sql("""select series_id, cast(coalesce(label, -1) as integer) as label from ds_pt left join (select p as series_id, min(comp) as comp from (
      select p, comp from ds_comp union all select n.p, c.comp from ds_near n join ds_comp c on c.p = n.q where n.p not in (select p from ds_core)) group by 1) using (series_id)
    left join ds_label using (comp)""", "ds_pt", "ds_near", "ds_core", "ds_comp", "ds_label", recursive=True),
)
def _(spark, d):
    return clu.cluster_density(points(spark, d), EPS, MIN_SAMPLES)


@query("cluster_density_search")
def _(spark, d):
    p = points(spark, d)
    return clu.DensitySearch(p, p.select("series_id").distinct().count()).fit(3).labels


fragment("as_near", "select target_id, arg_min(train_id, struct_pack(d := distance, i := train_id)) as train_id from (select t.series_id as target_id, s.series_id as train_id, sqrt(sum((t.value - s.value) * (t.value - s.value))) as distance from pt_test t join pt_train s using (feature) group by 1, 2) group by 1", "pt_train", "pt_test")
fragment("assigned", "select target_id as series_id, label from as_near join bands on bands.series_id = train_id and k = 4", "as_near", "bands")


def assigned(spark, d):
    labels = banded(spark, d).where("k = 4").drop("k")
    return labels, clu.assign_cluster(points(spark, d, "test"), points(spark, d), labels)


@query("assign_cluster", sql("select series_id, label from assigned", "assigned"))
def _(spark, d):
    return assigned(spark, d)[1]


@query("cluster_counts", sql("select label, n_train, coalesce(n_target, 0) as n_target from (select label, count(*) as n_train from bands where k = 4 group by 1) left join (select label, count(*) as n_target from assigned group by 1) using (label)", "assigned", "bands"))
def _(spark, d):
    return clu.cluster_counts(*assigned(spark, d))


def _octants() -> str:
    out = []
    for bits in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]:
        conds, dist = [], []
        for x, bit in zip("abc", bits):
            mid = f"(0.5e0 * (l{x} + h{x}))"
            lo, hi = (f"l{x}", mid) if bit == 0 else (mid, f"h{x}")
            conds.append(f"{x} >= {lo} and {x} <= {hi}")
            dist.append(f"({x} - 0.5e0 * ({lo} + {hi})) * ({x} - 0.5e0 * ({lo} + {hi}))")
        out.append(f"select '{'-'.join(map(str, bits))}' as octant, series_id, sqrt({' + '.join(dist)}) as distance from ds_pt, ds_box where {' and '.join(conds)}")
    return " union all ".join(out)


fragment("ds_box", "select min(a) as la, max(a) as ha, min(b) as lb, max(b) as hb, min(c) as lc, max(c) as hc from ds_pt", "ds_pt")
fragment("octants", _octants(), "ds_pt", "ds_box")


@query("octant_representatives", sql(f"select octant, arg_min(series_id, struct_pack(d := distance, s := series_id)) as series_id, {R('min(distance)')} as distance from octants group by 1", "octants"))
def _(spark, d):
    return clu.octant_representatives(points(spark, d), AXES).withColumn("distance", rnd("distance"))


@query(
    "pred_cluster_rule",
    sql("""select series_id, metric, mean, lower, upper from assigned join (select label, metric, round_even(avg(value) + 1e-9, 4) as mean, round_even(quantile_cont(value, 0.025) + 1e-9, 4) as lower, round_even(quantile_cont(value, 0.975) + 1e-9, 4) as upper
    from bands join fc_eval using (series_id) where k = 4 and split = 'train' group by 1, 2) using (label)""", "assigned", "bands", "fc_eval"),
)
def _(spark, d):
    labels, mine = assigned(spark, d)
    return pr.pred_cluster(labels, mine, base_run(spark, d).of("fc_eval", "train"))


def _pred_clusters(spark, d, name, counts, **kw):
    train, run = points(spark, d), base_run(spark, d)
    labels = clu.fit_clusters(name, train, train.select("series_id").distinct().count(), counts, **kw)
    return pr.pred_cluster(labels, clu.assign_cluster(points(spark, d, "test"), train, labels), run.of("fc_eval", "train"))


@query("pred_kmeans")
def _(spark, d):
    return _pred_clusters(spark, d, "cl_kmeans_cv", [3, 5, 7])


@query("pred_hier")
def _(spark, d):
    return _pred_clusters(spark, d, "cl_hier_cv", [3, 5, 7])


@query("pred_density")
def _(spark, d):
    return _pred_clusters(spark, d, "cl_density_cv", [2, 3])


# ---- meta-learning ------------------------------------------------------------------------------

MK = "series_id, window_id"
META_FEATURES = ["acf_lag1", "crossing_points", "kurtosis", "linearity", "skewness", "spikiness", "diff_acf_lag1", "acf_lag5_squared"]
STATIC = ["series_length", "full_series_mean", "full_series_std"]
meanfill_fragment("meta_mf", "p25_meta", MK, META_H)
score_fragments("meta", "p25_meta", "meta_mf", MK, residual_tests=False)
fragment("mpast", "select series_id, window_id, pos, y from p25_meta where part = 'past'", "p25_meta")
feature_fragments("mpast", MK)
_dyn = ", ".join(f"{R(f'm.{n}')} as {n}" for n in META_FEATURES)
_sta = ", ".join(f"{R(f'a.{n}', 2)} as {n}" for n in STATIC)
fragment(
    "meta_rows",
    f"select {MK}, {_dyn}, {_sta}, {', '.join(f'{R(f"s.{m}")} as {m}' for m in mt.PREDICTABILITY)}, {META_H}e0 as horizon from mpast_agg m join p25_agg a using (series_id) join meta_pred s using ({MK})",
    "mpast_agg", "p25_agg", "meta_pred",
)
_META: dict[tuple, object] = {}


def meta_rows(spark, d):
    rows = mm.meta_training_set(panel(spark, d, "p25"), "meanfill", META_H, 5, mt.PREDICTABILITY, META_FEATURES)
    return rows.select("series_id", "window_id", *[rnd(n).alias(n) for n in META_FEATURES], *[rnd(n, 2).alias(n) for n in STATIC], *[rnd(m).alias(m) for m in mt.PREDICTABILITY], "horizon")


@query("meta_training_set", sql("select * from meta_rows", "meta_rows"))
def _(spark, d):
    return meta_rows(spark, d)


_feats = ", ".join(f"struct_pack(f := '{n}', v := {n})" for n in META_FEATURES)
fragment("meta_long", f"select {MK}, u.f as feature, u.v as value from (select {MK}, unnest([{_feats}]) as u from meta_rows)", "meta_rows")
fragment("meta_stats", "select feature, avg(value) as mean, stddev_samp(value) as std, quantile_cont(value, 0.01) as q01, quantile_cont(value, 0.99) as q99 from meta_long group by 1", "meta_long")


@query("feature_stats", sql(f"select feature, {R('mean')} as mean, {R('std')} as std, {R('q01')} as q01, {R('q99')} as q99 from meta_stats", "meta_stats"))
def _(spark, d):
    return mm.feature_stats(meta_rows(spark, d), META_FEATURES, ["series_id", "window_id"]).select("feature", *[rnd(c).alias(c) for c in ["mean", "std", "q01", "q99"]])


feature_fragments("p125")
fragment("p125_meta", f"select series_id, u.f as feature, u.v as value from (select series_id, unnest([{', '.join(f"struct_pack(f := '{n}', v := {R(n)})" for n in META_FEATURES)}]) as u from p125_agg)", "p125_agg")


@query(
    "ood_flags",
    sql("""select series_id, count(case when value < q01 or value > q99 then 1 end) as n_out, coalesce(string_agg(case when value < q01 or value > q99 then feature end, ',' order by feature), '') as features
    from p125_meta join meta_stats using (feature) group by 1""", "p125_meta", "meta_stats"),
)
def _(spark, d):
    stats = mm.feature_stats(meta_rows(spark, d), META_FEATURES, ["series_id", "window_id"])
    feats = ft.compute_features(panel(spark, d, "p125"), META_FEATURES).withColumn("value", rnd("value"))
    return mm.ood_flags(feats, stats)


@query("dataset_fingerprint")
def _(spark, d):
    return mm.dataset_fingerprint(panel(spark, d, "p125"))


@query("group_kfold_r2")
def _(spark, d):
    return mm.group_kfold_r2(meta_rows(spark, d), [*META_FEATURES, *STATIC], ["rpa"], trees=20)


def bundle(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _META:
        _META[key] = mm.fit_meta_model(meta_rows(spark, d), mt.PREDICTABILITY, STATIC, META_FEATURES, META_H, trees=20)
    return _META[key]


@query("fit_meta_model")
def _(spark, d):
    return spark.createDataFrame(bundle(spark, d).importances(), "metric string, feature string, importance double")


@query("predict_meta")
def _(spark, d):
    """Scores of 125 series no model has seen, from their features alone."""
    return mm.predict_meta(bundle(spark, d), panel(spark, d, "p125"), META_H)


@query("predict_meta_warned")
def _(spark, d):
    """The same with the features of every series that the training set does not cover."""
    return mm.predict_meta(bundle(spark, d), panel(spark, d, "p125"), META_H, warn=True)


@query("pred_meta")
def _(spark, d):
    """The same as a predictor of the study: histories of the test windows."""
    return mm.predict_meta(bundle(spark, d), base_run(spark, d).of("past", "test"), META_H)


# ---- boosting -----------------------------------------------------------------------------------

LAGS, ROLLS = [1, 2, 3, 7, 14, 28, 52, 104], [7, 28, 52]
_l = ", ".join(f"lag(y, {k}) over w as lag{k}" for k in LAGS)
_r = ", ".join(f"case when count(y) over (partition by series_id order by pos rows between {k} preceding and 1 preceding) = {k} then avg(y) over (partition by series_id order by pos rows between {k} preceding and 1 preceding) end as roll_mean_{k}, "
               f"stddev_samp(y) over (partition by series_id order by pos rows between {k} preceding and 1 preceding) as roll_std_{k}" for k in ROLLS)
_DESIGN = [f"lag{k}" for k in LAGS] + [f"{n}_{k}" for k in ROLLS for n in ("roll_mean", "roll_std")]


@query(
    "lag_features",
    sql(f"""select series_id, pos, {', '.join(R(c + ' + 1e-7', 2) + f' as {c}' for c in _DESIGN)}, cast(isodow(ts) - 1 as integer) as weekday, cast(month(ts) as integer) as month
    from (select series_id, pos, ts, {_l}, {_r} from p25 window w as (partition by series_id order by pos)) where lag104 is not null""", "p25"),
)
def _(spark, d):
    lags, rolls = gb.design_shape(52, 345)
    out = gb.lag_features(panel(spark, d, "p25"), lags, rolls)
    return out.select("series_id", "pos", *[rnd(F.col(c) + 1e-7, 2).alias(c) for c in _DESIGN], "weekday", "month")


@query(
    "fc_gbt_fit_dates",
    sql(
        """select split, series_id, window_id, e.cut, d.cut as fitted_to, ahead > d.cut as before_horizon
from (select split, series_id, window_id, max(ts) filter (part = 'past' and y is not null) as cut, min(ts) filter (part = 'horizon') as ahead from p25_tvt group by 1, 2, 3) e
asof join (select distinct cut from (select max(ts) as cut from p25_tvt where part = 'past' and y is not null group by split, series_id, window_id)) d on d.cut <= e.cut""",
        "p25_tvt",
    ),
)
def _(spark, d):
    """What the booster of every window has seen at most, and that it ends before the window's horizon."""
    keys = ["split", "series_id", "window_id"]
    windows = win.train_val_test(panel(spark, d, "p25"), n=5, h=H)
    ahead = windows.where("part = 'horizon'").groupBy(*keys).agg(F.min("ts").alias("ahead"))
    dates = gb.fit_dates(windows.where("part = 'past'"), keys)
    return dates.join(ahead, keys).select(*keys, "cut", "fitted_to", (F.col("ahead") > F.col("fitted_to")).alias("before_horizon"))


@query("fc_gbt_panel")
def _(spark, d):
    return forecast_rows(gb.fc_gbt_panel(held_out(spark, d)[1], H, step="week"))


# ---- reports ------------------------------------------------------------------------------------


def hist_sql(src: str, keys: str) -> str:
    return f"""select {keys}, cast(b as integer) as bin, {R("lo + b * (hi - lo) / 40 + 1e-9", 7)} as left_edge, coalesce(n, 0) as n from (select * from (select {keys}, min(value) as lo, max(value) as hi from {src} group by all), (select unnest(range(0, 40)) as b))
    left join (select {keys}, cast(case when hi > lo then least(39, floor((value - lo) / (hi - lo) * 40)) else 0 end as bigint) as b, count(*) as n from {src} join (select {keys}, min(value) as lo, max(value) as hi from {src} group by all) using ({keys}) group by all) using ({keys}, b)"""


def _hist(name: str, src: str, keys: list[str], frame, *deps: str) -> None:
    @query(name, sql(hist_sql(src, ", ".join(keys)), *deps))
    def _(spark, d):
        return rp.histogram(frame(base_run(spark, d)), keys).select(*keys, "bin", rnd(F.col("left_edge") + 1e-9, 7).alias("left_edge"), "n")


_hist("hist_features", "wpast_base", ["split", "feature"], lambda run: run["features"], "wpast_base")
_hist("hist_fc_eval", "fc_eval", ["split", "metric"], lambda run: run["fc_eval"], "fc_eval")
_hist("hist_pred", "(select *, mean as value from pred)", ["split", "predictor", "metric"], lambda run: run["pred"].withColumn("value", F.col("mean")), "pred")
_hist("hist_pred_eval", "pred_eval", ["split", "predictor", "pred_metric", "metric"], lambda run: run["pred_eval"], "pred_eval")
fragment("pbest", "select series_id, arg_min(predictor, struct_pack(r := pred_rank, p := predictor)) as predictor from dev_avg group by 1", "dev_avg")


@query(
    "best_method_dist",
    sql(f"""select predictor, coalesce(a, 0) as n_actual, coalesce(p, 0) as n_predicted, {R('100e0 * coalesce(a, 0) / sum(a) over ()')} as share_actual, {R('100e0 * coalesce(p, 0) / sum(p) over ()')} as share_predicted
    from (select distinct predictor from scores) left join (select predictor, count(*) as a from best where split = 'test' group by 1) using (predictor) left join (select predictor, count(*) as p from pbest group by 1) using (predictor)""", "scores", "best", "pbest"),
)
def _(spark, d):
    run = base_run(spark, d)
    out = rp.best_method_dist(run.of("best_method", "test"), rk.predicted_best(run["rank_deviation"]), run["scores"])
    return out.select("predictor", "n_actual", "n_predicted", rnd("share_actual").alias("share_actual"), rnd("share_predicted").alias("share_predicted"))


fragment("dev_all", f"select predictor, greatest({1 - P}, least({P - 1}, deviation)) as deviation from dev_avg union all select '__all__', greatest({1 - P}, least({P - 1}, deviation)) from dev_avg", "dev_avg")


@query(
    "rank_dev_hist",
    sql(f"""select predictor, cast(b as integer) as bin, coalesce(n, 0) as n from (select * from (select distinct predictor from dev_all), (select unnest(range({1 - P}, {P})) as b))
    left join (select predictor, cast(round_even(deviation, 0) as bigint) as b, count(*) as n from dev_all group by all) using (predictor, b)""", "dev_all"),
)
def _(spark, d):
    dev = rp.clamp_deviation(base_run(spark, d)["rank_deviation"], P)
    both = dev.unionByName(dev.withColumn("predictor", F.lit("__all__")))
    return rk.deviation_histogram(both, P, ["predictor"])


def violin_sql(src: str, keys: str, value: str = "value") -> str:
    return f"select {keys}, count({value}) as n, " + ", ".join(f"{R(f'quantile_cont({value}, {q})')} as {n}" for n, q in rp.VIOLIN.items()) + f" from {src} group by all"


def _violin(df, keys):
    return df.select(*keys, "n", *[rnd(c).alias(c) for c in rp.VIOLIN])


VK = ["split", "predictor", "pred_metric", "metric"]


@query("violin_summary", sql(violin_sql("pred_eval", ", ".join(VK)), "pred_eval"))
def _(spark, d):
    return _violin(rp.violin_summary(base_run(spark, d)["pred_eval"], VK), VK)


@query("violin_summary_averaged", sql(violin_sql("(select split, predictor, pred_metric, series_id, avg(value) as value from pred_eval group by all)", ", ".join(VK[:3])), "pred_eval"))
def _(spark, d):
    return _violin(rp.violin_summary(rp.averaged_per_series(base_run(spark, d)["pred_eval"], VK[:3]), VK[:3]), VK[:3])


@query("rank_violin", sql(f"select 'real' as kind, * from ({violin_sql('dev_avg', 'predictor', 'real_rank')}) union all select 'predicted', * from ({violin_sql('dev_avg', 'predictor', 'pred_rank')})", "dev_avg"))
def _(spark, d):
    dev = base_run(spark, d)["rank_deviation"]
    parts = [_violin(rp.violin_summary(dev, ["predictor"], c), ["predictor"]).select(F.lit(k).alias("kind"), "*") for k, c in [("real", "real_rank"), ("predicted", "pred_rank")]]
    return parts[0].unionAll(parts[1])


@query(
    "quadrant_table",
    sql(f"""select series_id, {R('reciprocal_rank')} as reciprocal_rank, {R('margin')} as margin, top1_agree as correct, {R('y')} as y_threshold,
    concat(case when margin >= y then 'high' else 'low' end, '_', case when reciprocal_rank >= 0.5e0 then 'right' else 'left' end) as quadrant from bme, (select median(margin) as y from bme)""", "bme"),
)
def _(spark, d):
    out = rp.quadrant_table(base_run(spark, d)["best_method_eval"])
    return out.select("series_id", rnd("reciprocal_rank").alias("reciprocal_rank"), rnd("margin").alias("margin"), "correct", rnd("y_threshold").alias("y_threshold"), "quadrant")


@query("assoc_matrix", sql("select split, feature, " + ", ".join(f"max(case when metric = '{m}' then rho end) as {m}" for m in METRICS) + " from sp_fc group by 1, 2", "sp_fc"))
def _(spark, d):
    from accuracast.operators import association as asc

    run = base_run(spark, d)
    rows = run["fc_eval"].withColumnRenamed("value", "y").join(run["features"].withColumnRenamed("value", "x"), UNIT)
    out = asc.spearman(rows, ["split", "metric", "feature"]).where("rho is not null")
    return rp.assoc_matrix(out, ["split", "feature"], "metric", METRICS)


@query("assoc_matrix_predictors", sql("select split, pred_metric, predictor, " + ", ".join(f"max(case when metric = '{m}' then pvalue end) as {m}" for m in METRICS) + " from sp_pf group by 1, 2, 3", "sp_pf"))
def _(spark, d):
    from accuracast.operators import association as asc

    run = base_run(spark, d)
    out = asc.assoc_pred_eval_vs_fc_eval(run["pred_eval"], run["fc_eval"].where("split <> 'train'")).where("rho is not null").withColumn("pvalue", rnd("pvalue"))
    return rp.assoc_matrix(out, ["split", "pred_metric", "predictor"], "metric", METRICS, "pvalue")


_pct = lambda c: f"concat(format('{{:.2f}}', round_even({c} * 100, 2)), '%')"


@query(
    "accuracy_table",
    sql(f"""select split, predictor, series_id, 'Predictability' as block, cast(list_position(['predictability', 'rpa', 'rqa', 'mia'], metric) - 1 as integer) as position, metric,
    {_pct('mean')} as mean, {_pct('lower')} as lower, {_pct('upper')} as upper from pred""", "pred"),
)
def _(spark, d):
    return rp.accuracy_table(base_run(spark, d)["pred"])


# ---- extension points and the whole study -------------------------------------------------------


@query("register_feature", sql(f"select series_id, {R('quantile_cont(y, 0.9) - quantile_cont(y, 0.1)', 2)} as value from p25 group by 1", "p25"))
def _(spark, d):
    from accuracast.registry import register_feature

    @register_feature("decile_range", groups=("user",), default=False)
    def _range():
        return F.percentile("y", 0.9) - F.percentile("y", 0.1)

    return ft.features_wide(panel(spark, d, "p25"), ["decile_range"]).select("series_id", rnd("decile_range", 2).alias("value"))


@query("register_metric", sql(f"select series_id, {R('max(abs(y - mean))', 2)} as value from p25_mf_pair group by 1", "p25_mf_pair"))
def _(spark, d):
    from accuracast.registry import register_metric

    @register_metric("worst_error", family="user")
    def _worst():
        return F.array_max(F.zip_with("y", "f", lambda a, b: F.abs(a - b)))

    rows, past = held_out(spark, d)
    units = mt.build_units(rows, fc.fc_meanfill(past, H))
    return mt.score_units(units, metrics=["worst_error"]).select("series_id", rnd("worst_error", 2).alias("value"))


@query("register_model", sql(f"select series_id, k as step, {R('y')} as mean from (select series_id, arg_max(y, pos) as y from p25_hold where part = 'past' group by 1), (select unnest(range(1, {H + 1})) as k)", "p25_hold"))
def _(spark, d):
    from accuracast.registry import register_model

    @register_model("last_value")
    def _last(past, h, keys=("series_id",), step=None):
        g = past.groupBy(*keys).agg(F.max_by("y", "pos").alias("v"), F.max("pos").alias("p"))
        future = g.select(*keys, fc.steps(h), "v", "p").select(*keys, "k", (F.col("p") + F.col("k")).alias("pos"), *[F.col("v").alias(c) for c in ["mean", "lower", "upper"]])
        history = past.select(*keys, "pos", "ts", "y", *[F.lag("y").over(win.over(keys)).alias(c) for c in ["fit", "fit_lower", "fit_upper"]])
        return fc.assemble(history, future, "LAST", h, step, keys)

    past = held_out(spark, d)[1]
    out = fc.forecast_panel(past, "last_value", H).where("mean is not null")
    last = past.groupBy("series_id").agg(F.max("pos").alias("p"))
    return out.join(last, "series_id").select("series_id", (F.col("pos") - F.col("p")).alias("step"), rnd("mean").alias("mean"))


@query(
    "register_predictor",
    sql("""select series_id, metric, mean, lower, upper from (select distinct series_id from ws where split = 'test'), (
      select metric, round_even(avg(value) + 1e-9, 4) as mean, round_even(min(value) + 1e-9, 4) as lower, round_even(max(value) + 1e-9, 4) as upper from fc_eval where split = 'train' group by 1)""", "ws", "fc_eval"),
)
def _(spark, d):
    from accuracast.registry import PREDICTORS, register_predictor

    @register_predictor("train_average")
    def _average(targets, train_eval):
        per = train_eval.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("lower"), F.max("value").alias("upper"))
        listed = per.agg(F.collect_list(F.struct("metric", "mean", "lower", "upper"))).scalar()  # one entry per metric
        return pr.rounded(targets.withColumn("_m", F.explode(listed)).select("series_id", "_m.metric", "_m.mean", "_m.lower", "_m.upper"))

    run = base_run(spark, d)
    return PREDICTORS["train_average"].build(run.of("past", "test").select("series_id").distinct(), run.of("fc_eval", "train"))


@query(
    "run_study_base",
    sql("""select split, predictor, count(*) as n_best from best group by 1, 2""", "best"),
)
def _(spark, d):
    return base_run(spark, d)["best_method"].groupBy("split", "predictor").agg(F.count(F.lit(1)).alias("n_best"))


@query("run_study")
def _(spark, d):
    """The whole study on the five segments, smoothing as the forecasting model; everything else as the operator has it."""
    run = st.run_study(panel(spark, d, "p5"), "ets", H)
    return run["scores"].groupBy("split", "predictor").agg(F.count(F.lit(1)).alias("n_series"), rnd(F.avg("score"), 4).alias("mean_score"))
