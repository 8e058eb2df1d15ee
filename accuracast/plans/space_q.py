"""Queries on the feature catalogue, the feature space and nearest series."""

from __future__ import annotations

from pyspark.sql import functions as F

from accuracast.functions.columns import rnd
from accuracast.operators import catalogue as ct
from accuracast.operators import features as ft
from accuracast.operators import featurespace as fs
from accuracast.plans.catalog import R, fragment, query, sql
from accuracast.plans.features_q import AGGREGATES, feature_fragments, places
from accuracast.sources.panels import panel

BASE = [n for n in AGGREGATES if n != "runs_ratio_sign_changes"] + ["pacf_lag5_squared", "weighted_permutation_entropy", "stability", "lumpiness"]
_COLS = {n: f"a.{n}" for n in BASE} | {"pacf_lag5_squared": "p.value", "weighted_permutation_entropy": "w.value", "stability": "r.stability", "lumpiness": "r.lumpiness"}

feature_fragments("p5")


def base_fragment(src: str, keys: str = "series_id", names=BASE) -> None:
    """Long features of a relation with feature CTEs, rounded as the queries round them."""
    items = ", ".join(f"struct_pack(feature := '{n}', value := {R(_COLS[n], places(n))})" for n in names)
    a = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    more = "".join(f" join {src}_{s} {t} using ({keys})" for s, t in [("pacf", "p"), ("wpe", "w"), ("rolled", "r")] if any(_COLS[n].startswith(t + ".") for n in names))
    deps = [f"{src}_agg"] + [f"{src}_{s}" for s, t in [("pacf", "p"), ("wpe", "w"), ("rolled", "r")] if any(_COLS[n].startswith(t + ".") for n in names)]
    fragment(f"{src}_base", f"select {keys}, u.feature as feature, u.value as value from (select {a}, unnest([{items}]) as u from {src}_agg a{more})", *deps)


base_fragment("p25")
base_fragment("p5")


def base_features(rows, keys=("series_id",), names=BASE):
    f = ft.compute_features(rows, names, keys)
    return f.withColumn("value", F.when(F.col("feature").startswith("full_series"), rnd("value", 2)).otherwise(rnd("value")))


# ---- catalogue ----------------------------------------------------------------------------------

_lag = ", ".join(f"lag(y, {k}) over w as l{k}, lead(y, {k}) over w as r{k}" for k in range(1, 11))
fragment(
    "cat_rows",
    f"""select *, case when y > mu then count(*) over (partition by series_id, y > mu, ra) end as sa, case when y < mu then count(*) over (partition by series_id, y < mu, rb) end as sb from (
    select *, i - sum(case when y > mu then 1 else 0 end) over w as ra, i - sum(case when y < mu then 1 else 0 end) over w as rb from (
    select series_id, pos, y, i, n, avg(y) over g as mu, stddev_pop(y) over g as sd, median(y) over g as med, min(y) over g as lo, max(y) over g as hi,
    sum(abs(y)) over g as mass, sum(abs(y)) over (partition by series_id order by pos rows unbounded preceding) as cum, count(*) over (partition by series_id, y) as copies, {_lag}
    from p25_clean window w as (partition by series_id order by pos), g as (partition by series_id)) window w as (partition by series_id order by pos rows unbounded preceding))""",
    "p25_clean",
)


def catalogue_sql() -> dict[str, str]:
    d, n = "(y - l1)", "count(y)"
    div = lambda a, b: f"case when {b} <> 0 then {a} / {b} end"
    flag = lambda c: f"sum(case when {c} then 1e0 else 0e0 end)"
    out = {
        "abs_energy": "sum(y * y)", "absolute_sum_of_changes": f"coalesce(sum(abs{d}), 0e0)", "mean_abs_change": f"avg(abs{d})", "mean_change": f"avg{d}",
        "mean_second_derivative_central": "avg((r1 - 2 * y + l1) / 2e0)", "mean": "avg(y)", "variance": "var_pop(y)", "standard_deviation": "stddev_pop(y)",
        "variation_coefficient": div("stddev_pop(y)", "avg(y)"), "root_mean_square": "sqrt(avg(y * y))", "median": "median(y)", "minimum": "min(y)", "maximum": "max(y)",
        "sum_values": "sum(y)", "length": "cast(count(y) as double)", "count_above_mean": flag("y > mu"), "count_below_mean": flag("y < mu"),
        "longest_strike_above_mean": "cast(coalesce(max(sa), 0) as double)", "longest_strike_below_mean": "cast(coalesce(max(sb), 0) as double)",
        "first_location_of_maximum": f"min(case when y = hi then i end) / cast({n} as double)", "last_location_of_maximum": f"(max(case when y = hi then i end) + 1) / cast({n} as double)",
        "first_location_of_minimum": f"min(case when y = lo then i end) / cast({n} as double)", "last_location_of_minimum": f"(max(case when y = lo then i end) + 1) / cast({n} as double)",
        "has_duplicate": "max(case when copies > 1 then 1e0 else 0e0 end)", "has_duplicate_max": "max(case when y = hi then case when copies > 1 then 1e0 else 0e0 end end)",
        "has_duplicate_min": "max(case when y = lo then case when copies > 1 then 1e0 else 0e0 end end)",
        "number_crossing_mean": flag("(y > mu) <> (l1 > mu)"), "number_crossing_0": flag("(y > 0) <> (l1 > 0)"), "range_count_one_sigma": flag("y >= mu - sd and y < mu + sd"),
        "value_count_0": flag("y = 0"), "linear_trend_slope": "regr_slope(y, i)", "linear_trend_intercept": "regr_intercept(y, i)", "linear_trend_rvalue": "corr(y, i)",
        "cid_ce": f"sqrt(sum({d} * {d}))", "cid_ce_normalized": div(f"sqrt(sum({d} * {d}))", "stddev_pop(y)"),
        "sum_of_reoccurring_data_points": "sum(case when copies > 1 then y else 0e0 end)", "sum_of_reoccurring_values": "sum(case when copies > 1 then y / copies else 0e0 end)",
        "percentage_of_reoccurring_points": "avg(case when copies > 1 then 1e0 else 0e0 end)",
        "percentage_of_reoccurring_values": "count(distinct case when copies > 1 then y end) / cast(count(distinct y) as double)",
        "large_standard_deviation": "case when stddev_pop(y) > 0.25e0 * (max(y) - min(y)) then 1e0 else 0e0 end",
        "symmetry_looking": "case when abs(avg(y) - median(y)) < 0.05e0 * (max(y) - min(y)) then 1e0 else 0e0 end",
        "ratio_value_number_to_length": f"count(distinct y) / cast({n} as double)",
    }
    for q in ct.QUANTILES:
        out[f"quantile_{ct.tag(q)}"] = f"quantile_cont(y, {q})"
    for r in ct.SIGMAS:
        out[f"ratio_beyond_r_sigma_{ct.tag(r)}"] = f"avg(case when abs(y - mu) > {r}e0 * sd then 1e0 else 0e0 end)"
    for s in ct.PEAK_SUPPORT:
        out[f"number_peaks_{s}"] = flag(" and ".join(f"y > l{k} and y > r{k}" for k in range(1, s + 1)))
    for k in range(1, ct.MAX_LAG + 1):
        out[f"autocorrelation_{k}"] = div(f"sum((y - mu) * (l{k} - mu)) / (count(y) - {k})", "var_pop(y)")
    for k in range(1, 4):
        out[f"time_reversal_asymmetry_{k}"] = f"avg(r{2 * k} * r{2 * k} * r{k} - r{k} * y * y)"
    for j in range(ct.CHUNKS):
        out[f"energy_ratio_by_chunks_{j}"] = div(f"sum(case when i >= {j} * ceil(n / 10e0) and i < {j + 1} * ceil(n / 10e0) then y * y else 0e0 end)", "sum(y * y)")
    for q in ct.MASS:
        out[f"index_mass_quantile_{ct.tag(q)}"] = f"(min(case when mass > 0 and cum / mass >= {q}e0 then i end) + 1) / cast(count(y) as double)"
    return out


def digits(v: str) -> str:
    """Leading digits of a value: characteristics range from shares to squared sums."""
    return f"case when abs({v}) < 1e-9 then 0e0 else {v} / pow(10e0, floor(log10(abs({v})))) end"


_items = ", ".join(f"struct_pack(feature := '{k}', value := {v})" for k, v in catalogue_sql().items())
fragment("cat_agg", f"select series_id, u.feature as feature, u.value as value from (select series_id, unnest([{_items}]) as u from cat_rows group by series_id)", "cat_rows")
fragment(
    "cat_entropy",
    """select series_id, 'binned_entropy_10' as feature, ln(sum(c)) - sum(c * ln(c)) / sum(c) as value from (select series_id, case when hi > lo then least(9, floor((y - lo) / (hi - lo) * 10)) else 0 end as b, cast(count(*) as double) as c from cat_rows group by 1, 2) group by 1
    union all select series_id, 'permutation_entropy_3', ln(sum(c)) - sum(c * ln(c)) / sum(c) from (select series_id, y <= r1 as a, y <= r2 as b, r1 <= r2 as e, cast(count(*) as double) as c from cat_rows where r2 is not null group by all) group by 1
    union all select series_id, 'agg_linear_trend_slope', regr_slope(m, j) from (select series_id, i // 10 as j, avg(y) as m from cat_rows group by 1, 2) group by 1
    union all select series_id, 'agg_linear_trend_intercept', regr_intercept(m, j) from (select series_id, i // 10 as j, avg(y) as m from cat_rows group by 1, 2) group by 1
    union all select series_id, 'benford_correlation', corr(o, p) from (select series_id, k, avg(case when g = k then 1e0 else 0e0 end) as o, log10(1 + 1e0 / k) as p from (
      select series_id, case when abs(y) > 0 then least(9, floor(abs(y) / pow(10e0, floor(log10(abs(y)))) + 1e-9)) end as g from cat_rows), (select unnest(range(1, 10)) as k) group by series_id, k) group by 1""",
    "cat_rows",
)


def partial_sql(lags: int) -> str:
    """Partial autocorrelations by one nested select a lag."""
    r = ", ".join(f"max(value) filter (where feature = 'autocorrelation_{k}') as r{k}" for k in range(1, lags + 1))
    inner = f"(select *, r1 as f1_1 from (select series_id, max(value) filter (where feature = 'length') as n, {r} from cat_agg group by 1))"
    for k in range(2, lags + 1):
        num = f"(r{k} - ({' + '.join(f'f{k - 1}_{j} * r{k - j}' for j in range(1, k))}))"
        den = f"nullif(1 - ({' + '.join(f'f{k - 1}_{j} * r{j}' for j in range(1, k))}), 0)"
        inner = f"(select *, {', '.join(f'f{k - 1}_{j} - f{k}_{k} * f{k - 1}_{k - j} as f{k}_{j}' for j in range(1, k))} from (select *, {num} / {den} as f{k}_{k} from {inner}))"
    items = ", ".join(f"struct_pack(feature := 'partial_autocorrelation_{k}', value := case when floor(n / 2) > {k} then f{k}_{k} end)" for k in range(1, lags + 1))
    return f"select series_id, u.feature as feature, u.value as value from (select series_id, unnest([{items}]) as u from {inner})"


fragment("cat_partial", partial_sql(ct.PARTIAL_LAGS), "cat_agg")


@query("feature_catalogue", sql(f"select series_id, feature, {R(digits("value") + " + 3e-9", 7)} as mantissa from (select * from cat_agg union all select * from cat_entropy union all select * from cat_partial)", "cat_agg", "cat_entropy", "cat_partial"))
def _(spark, d):
    out = ct.feature_catalogue(panel(spark, d, "p25"))
    return out.select("series_id", "feature", rnd(F.expr(digits("value")) + 3e-9, 7).alias("mantissa"))


# ---- feature space ------------------------------------------------------------------------------

fragment("p25_holes", "select series_id, feature, case when value < 0 then null else value end as value from p25_base", "p25_base")


def holes(spark, d):
    return base_features(panel(spark, d, "p25")).withColumn("value", F.when(F.col("value") >= 0, F.col("value")))


@query(
    "feature_nan_cut",
    sql(f"""select series_id, feature, {R('coalesce(value, m)')} as value from p25_holes join (select feature, median(value) as m, avg(case when value is null then 1e0 else 0e0 end) as gap
    from p25_holes group by 1) using (feature) where gap <= 0.1e0""", "p25_holes"),
)
def _(spark, d):
    return fs.feature_nan_cut(holes(spark, d)).withColumn("value", rnd("value"))


@query("apply_norm_features", sql(f"select series_id, feature, {R('coalesce(value, m, 0e0)')} as value from p25_holes join (select feature, median(value) as m from p25_holes group by 1) using (feature)", "p25_holes"))
def _(spark, d):
    return fs.apply_norm_features(holes(spark, d)).withColumn("value", rnd("value"))


def zscore_fragments(train: str, target: str, out: str, key: str = "series_id") -> None:
    fragment(f"{out}_stats", f"select feature, avg(value) as mu, case when stddev_pop(value) > 0 then stddev_pop(value) else 1e0 end as sigma from {train} group by 1", train)
    fragment(out, f"select {key}, feature, coalesce((value - mu) / sigma, 0e0) as value from {target} join {out}_stats using (feature)", target, f"{out}_stats")


zscore_fragments("p25_base", "p25_base", "p25_z")
zscore_fragments("p25_base", "p5_base", "p5_z")


@query("zscore_features", sql(f"select 'train' as part, series_id, feature, {R('value')} as value from p25_z union all select 'target', series_id, feature, {R('value')} from p5_z", "p25_z", "p5_z"))
def _(spark, d):
    train, target = base_features(panel(spark, d, "p25")), base_features(panel(spark, d, "p5"))
    stats = fs.zscore_stats(train)
    parts = [fs.zscore_features(x, stats).select(F.lit(n).alias("part"), "series_id", "feature", rnd("value").alias("value")) for n, x in [("train", train), ("target", target)]]
    return parts[0].unionAll(parts[1])


fragment("p25_box", "select feature, min(value) as lo, max(value) as hi from p25_base group by 1", "p25_base")
_UNIT = R("(value - lo) / case when hi > lo then hi - lo else 1e0 end")


@query("minmax_scale", sql(f"select 'train' as part, series_id, feature, {_UNIT} as value from p25_base join p25_box using (feature) union all select 'target', series_id, feature, {_UNIT} from p5_base join p25_box using (feature)", "p25_box", "p5_base"))
def _(spark, d):
    train, target = base_features(panel(spark, d, "p25")), base_features(panel(spark, d, "p5"))
    stats = fs.minmax_stats(train)
    parts = [fs.minmax_scale(x, stats).select(F.lit(n).alias("part"), "series_id", "feature", rnd("value").alias("value")) for n, x in [("train", train), ("target", target)]]
    return parts[0].unionAll(parts[1])


@query(
    "robust_scale",
    sql(f"select feature, {R('median(value)')} as centre, {R('case when quantile_cont(value, 0.75) > quantile_cont(value, 0.25) then quantile_cont(value, 0.75) - quantile_cont(value, 0.25) else 1e0 end')} as iqr from p25_z group by 1", "p25_z"),
)
def _(spark, d):
    train = base_features(panel(spark, d, "p25"))
    return fs.robust_stats(fs.zscore_features(train, fs.zscore_stats(train))).select("feature", rnd("centre").alias("centre"), rnd("iqr").alias("iqr"))


@query("pca_reduce")
def _(spark, d):
    train = base_features(panel(spark, d, "p25"))
    return fs.FeatureSpace(train, ["series_id"]).transform(train).withColumn("value", rnd("value"))


@query("transform_target")
def _(spark, d):
    space = fs.FeatureSpace(base_features(panel(spark, d, "p25")), ["series_id"])
    return space.transform(base_features(panel(spark, d, "p5"))).withColumn("value", rnd("value"))


def nearest_fragments(out: str, train_z: str, target_z: str, k: int, min_k: int = 5, alpha: float = 4.0) -> None:
    """Neighbour lists with the elbow cut; relations (series_id, feature, value), already scaled."""
    fragment(f"{out}_dist", f"select t.series_id as target_id, s.series_id as train_id, sqrt(sum((t.value - s.value) * (t.value - s.value))) as distance from {target_z} t join {train_z} s using (feature) group by 1, 2", train_z, target_z)
    fragment(f"{out}_top", f"select *, count(*) over (partition by target_id) as m from (select *, row_number() over (partition by target_id order by distance, train_id) as rank from {out}_dist) where rank <= {k}", f"{out}_dist")
    fragment(f"{out}_jump", f"select *, (lead(distance) over (partition by target_id order by rank) - distance) / greatest(distance, 1e-12) as jump from {out}_top", f"{out}_top")
    fragment(
        out,
        f"""select target_id, train_id, cast(rank as integer) as rank, distance from {out}_jump join (
          select target_id, greatest({min(min_k, k)}, least(coalesce(min(case when jump > med + {alpha}e0 * mad then rank end), min(m)), min(m))) as used from (
            select *, median(abs(jump - med)) over (partition by target_id) + 1e-12 as mad from (select *, median(jump) over (partition by target_id) as med from {out}_jump)) group by 1)
        using (target_id) where rank <= used""",
        f"{out}_jump",
    )


nearest_fragments("p5_near", "p25_z", "p5_z", 30)


@query("nearest_series", sql(f"select target_id, train_id, rank, {R('distance')} as distance from p5_near", "p5_near"))
def _(spark, d):
    train, target = base_features(panel(spark, d, "p25")), base_features(panel(spark, d, "p5"))
    return fs.nearest_series(train, target, k=30).withColumn("distance", rnd("distance"))
