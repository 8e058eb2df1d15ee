"""Queries on order selection and autoregressive moving-average models."""

from __future__ import annotations

from pyspark.sql import functions as F

from accuracast.functions.columns import rnd
from accuracast.functions.stats import adf_p_sql, kpss_p_sql
from accuracast.operators import arima as ar
from accuracast.operators import forecasters as fc
from accuracast.plans.catalog import R, fragment, query, sql
from accuracast.plans.features_q import stationarity_fragments
from accuracast.plans.forecast_q import FC_COLS, forecast_rows, held_out
from accuracast.plans.panels_q import H
from accuracast.sources.panels import panel


# every series as it is, differenced once and twice at lag 1 (d) and at lag 52 (s)
fragment(
    "p25t_raw",
    """with recursive tried as (
      select series_id, t, 0 as o, i, y, n as n0 from p25_clean, (select unnest(['d', 's']) as t)
      union all
      select a.series_id, a.t, a.o + 1, a.i, a.y - b.y, a.n0 from tried a join tried b
        on b.series_id = a.series_id and b.t = a.t and b.o = a.o and b.i = a.i - case when a.t = 'd' then 1 else 52 end where a.o < 2)
    select concat(series_id, '|', t, o) as series_id, series_id as name, t, o, i, y, n0 from tried""",
    "p25_clean",
)
fragment(
    "p25t_dev",
    """select series_id, name, t, o, n0, y, row_number() over (w order by i) - 1 as i, count(*) over w as n, y - avg(y) over w as e from p25t_raw window w as (partition by series_id)""",
    "p25t_raw",
)
stationarity_fragments("p25t")
fragment(
    "p25_tried",
    f"""select name as series_id, t, o, n0, nonzero, flat, abs(coalesce(case when n > 52 and not flat then r end, 1e0)) as acf, not flat and n >= 10
      and coalesce({adf_p_sql('a.stat')}, 1e0) < 0.05e0 and coalesce({kpss_p_sql('p.stat')}, 1e0) > 0.05e0 as stationary
    from (select series_id, any_value(name) as name, any_value(t) as t, any_value(o) as o, any_value(n0) as n0, count(*) as n, min(y) >= max(y) as flat, count(case when y <> 0 then 1 end) as nonzero from p25t_dev group by 1) u
    left join p25t_adf a using (series_id) left join p25t_kpss p using (series_id)
    left join (select series_id, max(case when k = 52 then g end) / max(case when k = 0 then g end) as r from p25t_prod group by 1) using (series_id)""",
    "p25t_dev", "p25t_adf", "p25t_kpss", "p25t_prod",
)


@query(
    "estimate_d",
    sql("""select series_id, case when bool_or(o = 0 and (n0 < 10 or flat or nonzero < 10)) then 0 else coalesce(min(case when stationary then o end), 2) end as d
    from p25_tried where t = 'd' group by 1""", "p25_tried", recursive=True),
)
def _(spark, d):
    return ar.estimate_d(panel(spark, d, "p25"))


@query(
    "estimate_D",
    sql("""select series_id, case when bool_or(o = 0 and (n0 < 104 or flat)) then 0 else coalesce(min(case when stationary and (acf <= 0.3e0 or acf <= 0.6e0 * base) then o end), 2) end as ds
    from (select *, max(case when o = 0 then acf end) over (partition by series_id) as base from p25_tried where t = 's') group by 1""", "p25_tried", recursive=True),
)
def _(spark, d):
    return ar.estimate_D(panel(spark, d, "p25"), 52, max_D=2)


fragment(
    "p25_year",
    """select a.series_id, a.pos, a.i, a.y, a.n, a.i % 52 as phase, case when a.i >= 26 and a.i + 26 <= a.n - 1 then
    sum(b.y * case when abs(b.i - a.i) = 26 then 0.5e0 else 1e0 end) / 52 end as trend
    from p25_clean a join p25_clean b on b.series_id = a.series_id and abs(b.i - a.i) <= 26 group by 1, 2, 3, 4, 5""",
    "p25_clean",
)
fragment(
    "p25_yearly",
    """select series_id, greatest(0e0, 1 - var_samp(y - trend - s) / var_samp(y - trend)) as strength from p25_year join (
      select series_id, phase, v - avg(v) over (partition by series_id) as s from (select series_id, phase, avg(y - trend) as v from p25_year group by 1, 2)) using (series_id, phase)
    where trend is not null group by 1""",
    "p25_year",
)


@query(
    "has_seasonality",
    sql(f"""select series_id, {R('r')} as acf_m, {R('strength')} as strength, n >= 104 and (abs(r) > 1.96e0 / sqrt(n) or strength >= 0.9e0) as seasonal
    from (select series_id, r from p25_acf where k = 52) join p25_yearly using (series_id) join (select distinct series_id, n from p25_clean) using (series_id)""",
        "p25_acf", "p25_yearly", "p25_clean"),
)
def _(spark, d):
    out = ar.has_seasonality(panel(spark, d, "p25"), 52)
    return out.select("series_id", rnd("acf_m").alias("acf_m"), rnd("strength").alias("strength"), "seasonal")


fragment("p25_w", "select series_id, pos, ts, y, y - lag(y) over (partition by series_id order by pos) as w from p25_hold where part = 'past'", "p25_hold")
fragment("p25_w1", "select *, lag(w) over (partition by series_id order by pos) as v from p25_w", "p25_w")
fragment(
    "p25_ar",
    """select series_id, phi, c, sqrt(sse / (n - 2)) as sigma, arg_max(y, pos) as yn, arg_max(w, pos) as wn, max(pos) as last from p25_w1 join (
      select series_id, regr_slope(w, v) as phi, regr_intercept(w, v) as c, regr_syy(w, v) - regr_slope(w, v) * regr_sxy(w, v) as sse, regr_count(w, v) as n from p25_w1 group by 1) using (series_id)
    group by 1, 2, 3, sse, n""",
    "p25_w1",
)


@query(
    "fc_arima",
    sql(f"""select series_id, concat('ARIMA(p,d,q)=(1, 1, 0)|{H}|', series_id) as model_key, pos, ts, {R('mean', 3)} as mean, {R('mean - half', 3)} as lower, {R('mean + half', 3)} as upper,
      null as fit, null as fit_lower, null as fit_upper from (
      select series_id, last + k as pos, yn + sum(pow(phi, j) * wn + c * (1 - pow(phi, j)) / (1 - phi)) as mean, 1.96e0 * sigma * sqrt(sum(pow((1 - pow(phi, j)) / (1 - phi), 2))) as half
      from p25_ar, (select unnest(range(1, {H + 1})) as k), (select unnest(range(1, {H + 1})) as j) where j <= k group by series_id, last, k, yn, sigma)
    join p25 using (series_id, pos)
    union all select series_id, concat('ARIMA(p,d,q)=(1, 1, 0)|{H}|', series_id), pos, ts, null, null, null, {R('f', 3)}, {R('f - 1.96e0 * sigma', 3)}, {R('f + 1.96e0 * sigma', 3)}
    from (select series_id, pos, ts, y - (w - c - phi * v) as f, sigma from p25_w1 join p25_ar using (series_id) where v is not null)""", "p25_ar", "p25_w1", "p25"),
)
def _(spark, d):
    return forecast_rows(ar.fc_arima(held_out(spark, d)[1], H, step="week", order=(1, 1, 0)), 3)


@query("fc_arima_ma")
def _(spark, d):
    return forecast_rows(ar.fc_arima(held_out(spark, d)[1], H, step="week", order=(1, 1, 1)))


@query("fc_sarima")
def _(spark, d):
    return forecast_rows(ar.fc_sarima(held_out(spark, d)[1], H, step="week", order=(1, 0, 1), seasonal_order=(1, 0, 1, 12)))


@query("fc_auto_arima")
def _(spark, d):
    return forecast_rows(ar.fc_auto_arima(held_out(spark, d)[1], H, step="week", m=52))


@query("forecast_panel")
def _(spark, d):
    """Every nation by three models; nothing may be missing from the result."""
    past = held_out(spark, d)[1]
    out = None
    for model, params in [("meanfill", {}), ("ets", {"trend": "add"}), ("arima", {"order": (2, 1, 0)})]:
        one = fc.forecast_panel(past, model, H, step="week", **params).where(F.col("mean").isNotNull())
        one = one.select(F.lit(model).alias("model"), "series_id", "pos", "ts", *[rnd(x, 2).alias(x) for x in FC_COLS[:3]])
        out = one if out is None else out.unionAll(one)
    return out
