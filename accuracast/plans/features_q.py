"""Queries on series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from accuracast.functions import columns as c
from accuracast.functions.columns import rnd
from accuracast.functions.stats import adf_p_sql, chi2_tail_sql, kpss_p_sql, normal_two_sided_sql
from accuracast.operators import features as ft
from accuracast.operators.linear import decompose, grouped_ols
from accuracast.plans.catalog import R, fragment, query, sql
from accuracast.sources.panels import panel


def feature_fragments(src: str, keys: str = "series_id") -> None:
    """CTEs with every feature of the relation ``src`` (keys, pos, y)."""
    w = f"(partition by {keys} order by pos)"
    on = " and ".join(f"a.{k} = b.{k}" for k in [k.strip() for k in keys.split(",")])
    cols = lambda t: ", ".join(f"{t}.{k.strip()}" for k in keys.split(","))
    fragment(f"{src}_clean", f"select {keys}, pos, y, row_number() over {w} - 1 as i, count(*) over (partition by {keys}) as n from {src} where y is not null", src)
    lags = ", ".join(f"lag(y, {k}) over w as l{k}" for k in range(1, 6))
    fragment(
        f"{src}_prep",
        f"""select *, y - l1 as d, l1 - l2 as d1, abs(cast(y > med as integer) - cast(l1 > med as integer)) as crossed from (
        select {keys}, pos, y, i, n, {lags}, avg(y) over g as mu, coalesce(stddev_samp(y) over g, 0) as sd, median(y) over g as med
        from {src}_clean window w as (partition by {keys} order by pos), g as (partition by {keys}))""",
        f"{src}_clean",
    )
    corr = [f"corr(y, l{k})" for k in range(1, 6)]
    e = "(y - mu)"
    fragment(
        f"{src}_acov",
        f"select {keys}, sum({e} * {e}) as v, " + ", ".join(f"sum({e} * (l{k} - mu)) / sum({e} * {e}) as r{k}" for k in range(1, 6)) + f" from {src}_prep group by {keys}",
        f"{src}_prep",
    )
    # partial autocorrelations from determinants of the autocorrelation matrix, orders 1..5
    fragment(
        f"{src}_pacf",
        f"""select {keys}, p1 * p1 + p2 * p2 + p3 * p3 + p4 * p4 + p5 * p5 as value from (
        select *, (r5 - f41 * r4 - f42 * r3 - f43 * r2 - p4 * r1) / (1 - f41 * r1 - f42 * r2 - f43 * r3 - p4 * r4) as p5 from (
        select *, f31 - p4 * p3 as f41, f32 - p4 * f32 as f42, p3 - p4 * f31 as f43 from (
        select *, (r4 - f31 * r3 - f32 * r2 - p3 * r1) / (1 - f31 * r1 - f32 * r2 - p3 * r3) as p4 from (
        select *, f21 - p3 * p2 as f31, p2 - p3 * f21 as f32 from (
        select *, (r3 - f21 * r2 - p2 * r1) / (1 - f21 * r1 - p2 * r2) as p3 from (
        select *, p1 - p2 * p1 as f21 from (select *, r1 as p1, (r2 - r1 * r1) / (1 - r1 * r1) as p2 from {src}_acov)))))))""",
        f"{src}_acov",
    )
    fragment(
        f"{src}_agg",
        f"""select {keys},
        case when abs(avg(y)) >= 1e-12 then coalesce(stddev_samp(y), 0) / abs(avg(y)) end as coefficient_of_variation,
        case when count(y) >= 4 then case when stddev_pop(y) > 0 then kurtosis(y) else 0 end end as kurtosis,
        avg(case when y = 0 then 1e0 else 0e0 end) as ratio_zeros,
        coalesce(avg(case when sign(y) <> sign(l1) then 1e0 when l1 is not null then 0e0 end), 0e0) as runs_ratio_sign_changes,
        {corr[0]} as acf_lag1, cast(count(y) as double) as series_length, avg(y) as full_series_mean, stddev_samp(y) as full_series_std,
        case when count(y) >= 3 then case when stddev_pop(y) > 0 then skewness(y) else 0 end end as skewness,
        corr(d, d1) as diff_acf_lag1, {' + '.join(f'{x} * {x}' for x in corr)} as acf_lag5_squared,
        case when count(y) >= 10 then avg(case when abs(y - mu) > 2 * sd then 1e0 else 0e0 end) end as spikiness,
        case when stddev_pop(y) > 0 then regr_r2(y, i) else 0e0 end as linearity, sum(crossed) / 2e0 / (count(y) - 1) as crossing_points
        from {src}_prep group by {keys}""",
        f"{src}_prep",
    )
    x = ["y", "x1", "x2", "x3"]
    mean = "((y + x1 + x2 + x3) / 4)"
    bits = [f"cast({x[a]} <= {x[b]} as integer)" for a in range(4) for b in range(a + 1, 4)]
    fragment(
        f"{src}_wpe",
        f"""select {keys}, greatest(0e0, least(1e0, (ln(sum(w)) - sum(case when w > 0 then w * ln(w) else 0e0 end) / sum(w)) / ln(24e0))) as value from (
          select {keys}, concat({', '.join(bits)}) as p, sum((({' + '.join(f'({v} - {mean}) * ({v} - {mean})' for v in x)})) / 3) as w
          from (select {keys}, y, lead(y, 1) over {w} as x1, lead(y, 2) over {w} as x2, lead(y, 3) over {w} as x3 from {src}_clean) where x3 is not null group by {keys}, p)
        group by {keys}""",
        f"{src}_clean",
    )
    fragment(
        f"{src}_roll",
        f"""select {cols('a')}, a.i, min(a.n) as n, case when count(b.y) >= greatest(2, least(10, min(a.n) // 4) // 2) then var_samp(b.y) end as v,
        case when count(b.y) >= least(10, min(a.n) // 4) // 2 then avg(b.y) end as m
        from {src}_clean a join {src}_clean b on {on} and b.i > a.i - least(10, a.n // 4) and b.i <= a.i group by {cols('a')}, a.i""",
        f"{src}_clean",
    )
    fragment(
        f"{src}_rolled",
        f"""select {keys}, case when min(n) >= 10 then 1 / (1 + stddev_pop(v) / avg(v)) end as stability,
        case when min(n) >= 10 then stddev_pop(m) / avg(m) end as lumpiness from {src}_roll group by {keys}""",
        f"{src}_roll",
    )
    fragment(f"{src}_dev", f"select *, y - avg(y) over (partition by {keys}) as e from {src}_clean", f"{src}_clean")
    fragment(
        f"{src}_acf",
        f"""select {cols('a')}, k, sum(a.e * b.e) / (select sum(c.e * c.e) from {src}_dev c where {' and '.join(f'c.{q.strip()} = a.{q.strip()}' for q in keys.split(','))}) as r
        from {src}_dev a join (select unnest(range(1, 61)) as k) on k <= least(60, a.n // 2) and a.i >= k
        join {src}_dev b on {on} and b.i = a.i - k group by {cols('a')}, k""",
        f"{src}_dev",
    )
    fragment(
        f"{src}_period",
        f"""select {keys}, cast(coalesce(m, 12) as integer) as m from (select distinct {keys} from {src}) left join (
          select {keys}, arg_max(k, struct_pack(r := r, k := -k)) as m from (select *, lag(r) over (partition by {keys} order by k) as p, lead(r) over (partition by {keys} order by k) as q from {src}_acf)
          where k >= 2 and r > p and r > q and r > 0.25e0 group by {keys}) using ({keys})""",
        src, f"{src}_acf",
    )
    fragment(
        f"{src}_trend",
        f"""select {cols('a')}, a.pos, a.i, a.y, a.n, a.m, a.i % a.m as phase,
        case when a.i >= a.m // 2 and a.i + a.m // 2 <= a.n - 1 and a.n >= 2 * a.m then
          sum(b.y * case when a.m % 2 = 0 and abs(b.i - a.i) = a.m // 2 then 0.5e0 else 1e0 end) / a.m end as trend
        from (select * from {src}_clean join {src}_period using ({keys})) a join {src}_clean b on {on} and abs(b.i - a.i) <= a.m // 2
        group by {cols('a')}, a.pos, a.i, a.y, a.n, a.m""",
        f"{src}_clean", f"{src}_period",
    )
    fragment(
        f"{src}_decomp",
        f"""select *, y - trend - seasonal as remainder from (select t.*, s.seasonal from {src}_trend t join (
          select {keys}, phase, s - avg(s) over (partition by {keys}) as seasonal from (select {keys}, phase, avg(y - trend) as s from {src}_trend group by {keys}, phase)
        ) s using ({keys}, phase))""",
        f"{src}_trend",
    )
    strong = lambda v, t: f"case when {t} < 1e-10 then 1e0 else greatest(0e0, 1 - {v} / {t}) end"
    fragment(
        f"{src}_strength",
        f"""select {keys}, {strong('var_pop(remainder)', 'var_pop(trend + remainder)')} as trend_strength,
        {strong('var_samp(remainder)', 'var_samp(seasonal + remainder)')} as seasonal_strength
        from {src}_decomp where trend is not null group by {keys}""",
        f"{src}_decomp",
    )


feature_fragments("p25")
feature_fragments("pe")

AGGREGATES = [
    "coefficient_of_variation", "kurtosis", "ratio_zeros", "runs_ratio_sign_changes", "acf_lag1", "series_length", "full_series_mean",
    "full_series_std", "skewness", "diff_acf_lag1", "acf_lag5_squared", "spikiness", "linearity", "crossing_points",
]
QUERY_NAMES = {"runs_ratio_sign_changes": "feat_runs_ratio", "hurst_exponent": "feat_hurst", "weighted_permutation_entropy": "feat_weighted_perm_entropy"}


def places(name: str) -> int:
    return 2 if name.startswith("full_series") else 6


def _register(name: str, deps: tuple[str, ...], source: str, expr: str) -> None:
    @query(QUERY_NAMES.get(name, f"feat_{name}"), sql(f"select series_id, {R(expr, places(name))} as value from {source}", *deps))
    def _(spark, d):
        return ft.features_wide(panel(spark, d, "p25"), [name]).select("series_id", rnd(name, places(name)).alias("value"))


for _name in AGGREGATES:
    _register(_name, ("p25_agg",), "p25_agg", _name)
_register("pacf_lag5_squared", ("p25_pacf",), "p25_pacf", "value")
_register("weighted_permutation_entropy", ("p25_wpe",), "p25_wpe", "value")
_register("stability", ("p25_rolled",), "p25_rolled", "stability")
_register("lumpiness", ("p25_rolled",), "p25_rolled", "lumpiness")
_register("trend_strength", ("p25_strength",), "p25_strength", "trend_strength")
_register("seasonal_strength", ("p25_strength",), "p25_strength", "seasonal_strength")

fragment(
    "p25_hurst",
    """select series_id, greatest(0e0, least(1e0, regr_slope(v, x))) as value from (
      select a.series_id, lag, ln(lag) as x, ln(greatest(stddev_samp(a.y - b.y), 1e-12)) as v
      from p25_clean a join (select distinct series_id, cast(floor(pow(10e0, 1 + (log10(n // 2) - 1) * k / 19e0) + 1e-9) as bigint) as lag
        from (select distinct series_id, n from p25_clean), (select unnest(range(0, 20)) as k)) l on l.series_id = a.series_id
      join p25_clean b on b.series_id = a.series_id and b.i = a.i - lag group by 1, 2) group by 1""",
    "p25_clean",
)
_register("hurst_exponent", ("p25_hurst",), "p25_hurst", "value")

# Unit-root test: normal equations of the common sample are reduced one column at a time; what is left of the last
# entry after k columns is the sum of squared residuals on the first k, so the lag count and the statistic follow.
_REDUCED = "[[m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] for j in range(1, len(m) + 1)] for i in range(1, len(m) + 1)]"


def _adf_fragments(src: str, name: str, base: str, lags: str, level: str, pivots: str) -> None:
    """Cross products over the rows that have ``lags`` lags, and their reductions."""
    fragment(
        f"{name}_cols",
        f"""select series_id, i, {lags} as lags, 0 as c, 1e0 as x from {base} where i > {lags}
        union all select series_id, i, {lags}, {level}, level from {base} where i > {lags}
        union all select b.series_id, b.i, b.{lags}, case when k = 0 then 1000 else 1 + k end, p.d from {base} b, (select unnest(range(0, 64)) as k) join {src}_adf_base p on p.series_id = b.series_id and p.i = b.i - k
          where b.i > b.{lags} and k <= b.{lags}""",
        base, f"{src}_adf_base",
    )
    fragment(f"{name}_gram", f"select a.series_id, any_value(a.lags) as lags, a.c as c1, b.c as c2, sum(a.x * b.x) as g from {name}_cols a join {name}_cols b on a.series_id = b.series_id and a.i = b.i group by 1, 3, 4", f"{name}_cols")
    fragment(f"{name}_m", f"select series_id, any_value(lags) as lags, list(r order by c1) as m from (select series_id, any_value(lags) as lags, c1, list(g order by c2) as r from {name}_gram group by 1, 3) group by 1", f"{name}_gram")
    fragment(f"{name}_steps", f"select series_id, lags, 0 as k, m from {name}_m union all select series_id, lags, k + 1, {_REDUCED} from {name}_steps where k < {pivots}", f"{name}_m")


def stationarity_fragments(src: str) -> None:
    """KPSS and unit-root statistics per series_id of ``src``_dev (series_id, i, n, e)."""
    fragment(f"{src}_prod", f"select a.series_id, k, min(a.n) as n, sum(a.e * b.e) as g from {src}_dev a join (select unnest(range(0, 60)) as k) on a.i >= k join {src}_dev b on b.series_id = a.series_id and b.i = a.i - k group by 1, 2", f"{src}_dev")
    fragment(
        f"{src}_kpss",
        f"""select series_id, eta / (n * n) / scale as stat, lags from (
          select l.series_id, l.lags, l.n, (sum(case when k = 0 then g else 2 * (1 - k / (lags + 1e0)) * g end)) / l.n as scale,
            (select sum(c * c) from (select series_id, sum(e) over (partition by series_id order by i) as c from {src}_dev) z where z.series_id = l.series_id) as eta
          from (select series_id, n, cast(least(floor(1.1447e0 * pow((s1 / s0) * (s1 / s0), 1e0 / 3) * pow(n, 1e0 / 3)), n - 1) as integer) as lags from (
            select series_id, min(n) as n, sum(case when k = 0 then g / n else g / (n / 2e0) end) as s0, sum(k * g / (n / 2e0)) as s1
            from {src}_prod where k <= floor(pow(n, 2e0 / 9) + 1e-9) group by 1)) l join {src}_prod p on p.series_id = l.series_id and k <= lags group by 1, 2, 3)""",
        f"{src}_prod", f"{src}_dev",
    )
    fragment(
        f"{src}_adf_base",
        f"""select series_id, i, n, least(n // 2 - 2, cast(ceil(12 * pow(n / 100e0, 0.25e0)) as integer)) as most, e, lag(e) over w as level, e - lag(e) over w as d
        from (select series_id, e, count(*) over (partition by series_id) as n, row_number() over (partition by series_id order by i) - 1 as i from {src}_dev) window w as (partition by series_id order by i)""",
        f"{src}_dev",
    )
    _adf_fragments(src, f"{src}_adf_a", f"{src}_adf_base", "most", "1", "lags + 2")
    fragment(
        f"{src}_adf_best",
        f"""select b.*, o.best from {src}_adf_base b join (
          select series_id, arg_min(k - 2, rows * ln(m[len(m)][len(m)] / rows) + 2 * k) as best from (
            select s.*, (select count(*) from {src}_adf_base b where b.series_id = s.series_id and b.i > b.most) as rows from {src}_adf_a_steps s where k >= 2) group by 1) o using (series_id)""",
        f"{src}_adf_base", f"{src}_adf_a_steps",
    )
    _adf_fragments(src, f"{src}_adf_b", f"{src}_adf_best", "best", "999", "lags + 1")
    fragment(
        f"{src}_adf",
        f"""select series_id, lags, m[v][v + 1] / sqrt(m[v][v]) / sqrt((m[v + 1][v + 1] - m[v][v + 1] * m[v][v + 1] / m[v][v]) / (m1 - lags - 2)) as stat from (
          select series_id, lags, m, len(m) - 1 as v, m1 from {src}_adf_b_steps join (select series_id, m[1][1] as m1 from {src}_adf_b_m) using (series_id) where k = lags + 1)""",
        f"{src}_adf_b_steps", f"{src}_adf_b_m",
    )


stationarity_fragments("p25")


@query("feat_kpss_pvalue", sql(f"select series_id, lags as kpss_lags, {R('stat')} as kpss_stat, {R(kpss_p_sql('stat'))} as value from p25_kpss", "p25_kpss"))
def _(spark, d):
    return ft.kpss_test(c.series_arrays(panel(spark, d, "p25"))).select("series_id", "kpss_lags", rnd("kpss_stat").alias("kpss_stat"), rnd("kpss_p").alias("value"))


@query("feat_adf_pvalue", sql(f"select series_id, {R('stat')} as adf_stat, {R(adf_p_sql('stat'))} as value from p25_adf", "p25_adf", recursive=True))
def _(spark, d):
    return ft.adf_test(c.series_arrays(panel(spark, d, "p25"))).select("series_id", rnd("adf_stat").alias("adf_stat"), rnd("adf_p").alias("value"))


fragment(
    "p25_lb",
    """select series_id, cast(lags as integer) as lags, n * (n + 2) * sum(g * g / (n - k)) / (v * v) as q
    from (select *, least(20, greatest(1, n // 4)) as lags, sum(case when k = 0 then g end) over (partition by series_id) as v from p25_prod)
    where k between 1 and lags group by series_id, lags, n, v""",
    "p25_prod",
)


@query("feat_ljung_box", sql(f"select series_id, lags as lb_lags, {R('q')} as lb_stat, {R(chi2_tail_sql('q', 'lags'))} as value from p25_lb", "p25_lb"))
def _(spark, d):
    return ft.ljung_box(c.series_arrays(panel(spark, d, "p25"))).select("series_id", "lb_lags", rnd("lb_stat").alias("lb_stat"), rnd("lb_p").alias("value"))


def bds_fragments(src: str, keys: str = "series_id") -> None:
    """BDS statistic of (keys, i, y, n) rows by brute-force pairs."""
    ks = [k.strip() for k in keys.split(",")]
    a_keys = ", ".join(f"a.{k}" for k in ks)
    on = " and ".join(f"a.{k} = b.{k}" for k in ks)
    fragment(f"{src}_nxt", f"select *, lead(y) over (partition by {keys} order by i) as nx, 1.5e0 * stddev_samp(y) over (partition by {keys}) as eps from {src}_clean", f"{src}_clean")
    fragment(
        f"{src}_near",
        f"""select {a_keys}, a.i, min(a.n) as n, sum(case when abs(a.y - b.y) < a.eps then 1 else 0 end) as rs,
        sum(case when b.i > a.i and abs(a.y - b.y) < a.eps then 1 else 0 end) as c1,
        sum(case when b.i > a.i and a.i >= 1 and abs(a.y - b.y) < a.eps then 1 else 0 end) as c1i,
        sum(case when b.i > a.i and abs(a.y - b.y) < a.eps and abs(a.nx - b.nx) < a.eps then 1 else 0 end) as c2
        from {src}_nxt a join {src}_nxt b on {on} group by {a_keys}, a.i""",
        f"{src}_nxt",
    )
    fragment(
        f"{src}_bds",
        f"""select {keys}, case when 2 * abs(k3 - p1 * p1) > 1e-12 then sqrt(n - 1) * (p2 - p1i * p1i) / (2 * abs(k3 - p1 * p1)) end as z from (
        select {keys}, min(n) as n, 2e0 * sum(c1) / (min(n) * (min(n) - 1)) as p1, 2e0 * sum(c1i) / ((min(n) - 1) * (min(n) - 2)) as p1i,
        2e0 * sum(c2) / ((min(n) - 1) * (min(n) - 2)) as p2, (sum(rs * rs) - 3e0 * sum(rs) + 2 * min(n)) / (min(n) * (min(n) - 1) * (min(n) - 2)) as k3
        from {src}_near group by {keys})""",
        f"{src}_near",
    )


bds_fragments("p25")


@query("feat_bds_pvalue", sql(f"select series_id, {R('z')} as bds_stat, {R(normal_two_sided_sql('z'))} as value from p25_bds", "p25_bds"))
def _(spark, d):
    return ft.bds_test(c.series_arrays(panel(spark, d, "p25"))).select("series_id", rnd("bds_stat").alias("bds_stat"), rnd("bds_p").alias("value"))


@query("infer_period", sql("select 'p25' as panel, series_id, m from p25_period union all select 'pe', series_id, m from pe_period", "p25_period", "pe_period"))
def _(spark, d):
    out = None
    for name in ["p25", "pe"]:
        one = ft.infer_period(panel(spark, d, name)).select(F.lit(name).alias("panel"), "series_id", "m")
        out = one if out is None else out.unionAll(one)
    return out


@query(
    "infer_period_by_index",
    sql("""select panel, series_id, cast(case when lo = hi and lo = 604800 then 52 when lo = hi and lo = 3600 then 8760 end as integer) as m from (
      select panel, series_id, min(gap) as lo, max(gap) as hi from (
        select 'p25' as panel, series_id, epoch(ts) - epoch(lag(ts) over (partition by series_id order by ts)) as gap from p25
        union all select 'pe', series_id, epoch(ts) - epoch(lag(ts) over (partition by series_id order by ts)) from pe) group by 1, 2)""", "p25", "pe"),
)
def _(spark, d):
    out = None
    for name in ["p25", "pe"]:
        one = ft.infer_period(panel(spark, d, name), by_index=True).select(F.lit(name).alias("panel"), "series_id", "m")
        out = one if out is None else out.unionAll(one)
    return out


@query("decompose", sql(f"select series_id, pos, {R('trend + 1e-7', 2)} as trend, {R('seasonal + 1e-7', 2)} as seasonal, {R('remainder + 1e-7', 2)} as remainder from p25_decomp", "p25_decomp"))
def _(spark, d):
    p = panel(spark, d, "p25")
    rows = p.join(ft.infer_period(p), "series_id")
    # means of cents often end on a rounding tie; the nudge makes both engines round it up
    return decompose(rows).select("series_id", "pos", *[rnd(F.col(x) + 1e-7, 2).alias(x) for x in ["trend", "seasonal", "remainder"]])


@query(
    "grouped_ols",
    sql(f"select series_id, {R('regr_intercept(y, l1)', 2)} as intercept, {R('regr_slope(y, l1)')} as slope, {R('1 - regr_r2(y, l1)')} as unexplained, count(l1) as n from p25_prep group by 1", "p25_prep"),
)
def _(spark, d):
    rows = ft.prepared(panel(spark, d, "p25"))
    fit = grouped_ols(rows, "y", ["l1"])
    var = rows.where("l1 is not null").groupBy("series_id").agg((F.var_pop("y") * F.count("y")).alias("sst"))
    return fit.join(var, "series_id").select(
        "series_id", rnd(F.get("beta", F.lit(0)), 2).alias("intercept"), rnd(F.get("beta", F.lit(1))).alias("slope"), rnd(F.col("sse") / F.col("sst")).alias("unexplained"), "n"
    )


ALL = ft.feature_names()
_COLS = {n: f"a.{n}" for n in AGGREGATES}
_COLS |= {"pacf_lag5_squared": "p.value", "weighted_permutation_entropy": "w.value", "stability": "r.stability", "lumpiness": "r.lumpiness",
          "trend_strength": "s.trend_strength", "seasonal_strength": "s.seasonal_strength", "kpss_pvalue": kpss_p_sql("k.stat"), "adf_pvalue": f"coalesce({adf_p_sql('d.stat')}, 1e0)"}


def features_cte(names: list[str]) -> str:
    items = ", ".join(f"struct_pack(feature := '{n}', value := {R(_COLS[n], places(n))})" for n in names)
    return f"""select series_id, u.feature as feature, u.value as value from (select a.series_id, unnest([{items}]) as u
    from p25_agg a join p25_pacf p using (series_id) join p25_wpe w using (series_id) join p25_rolled r using (series_id) join p25_strength s using (series_id) join p25_kpss k using (series_id) left join p25_adf d using (series_id))"""


fragment("p25_features", features_cte(ALL), "p25_agg", "p25_pacf", "p25_wpe", "p25_rolled", "p25_strength", "p25_kpss", "p25_adf")


def rounded_features(spark, d):
    f = ft.compute_features(panel(spark, d, "p25"), ALL)
    return f.withColumn("value", F.when(F.col("feature").startswith("full_series"), rnd("value", 2)).otherwise(rnd("value")))


@query("compute_features", sql("select * from p25_features", "p25_features", recursive=True))
def _(spark, d):
    return rounded_features(spark, d)


@query(
    "interpret_features",
    sql(f"select series_id, feature, value, {ft.interpretation_sql('round_even', 'varchar')} as interpretation from (select *, value as v from p25_features)", "p25_features", recursive=True),
)
def _(spark, d):
    return ft.interpret_features(rounded_features(spark, d))


_STUDY = ft.feature_names("study")
_STATIC = ft.feature_names("meta_learning", True)


@query(
    "features_by_group",
    sql(f"""select 'study' as grp, * from p25_features where feature in ({', '.join(f"'{n}'" for n in _STUDY)})
    union all select 'static', * from p25_features where feature in ({', '.join(f"'{n}'" for n in _STATIC)})""", "p25_features", recursive=True),
)
def _(spark, d):
    f = rounded_features(spark, d)
    one = ft.features_by_group(f, "study").select(F.lit("study").alias("grp"), "*")
    return one.unionAll(ft.features_by_group(f, "meta_learning", True).select(F.lit("static").alias("grp"), "*"))
