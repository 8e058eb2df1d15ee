"""Queries on forecast metrics, scores and forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from accuracast.functions.columns import rnd
from accuracast.functions.stats import chi2_tail_sql, normal_two_sided_sql
from accuracast.operators import cleaning as cl
from accuracast.operators import forecasters as fc
from accuracast.operators import metrics as mt
from accuracast.plans.catalog import R, fragment, query, sql
from accuracast.plans.features_q import bds_fragments
from accuracast.plans.panels_q import H
from accuracast.sources.panels import panel


def score_fragments(p: str, actual: str, forecast: str, keys: str, residual_tests: bool = True) -> None:
    """Scores of ``forecast`` (keys, pos, mean, lower, upper) against ``actual`` (keys, pos, y, part)."""
    fragment(f"{p}_past", f"select {keys}, y from {actual} where part = 'past' and y is not null", actual)
    fragment(
        f"{p}_scale",
        f"""select {keys}, pmax, case when mad > 1e-12 then mad when iqr > 1e-12 then iqr / 1.349e0 when size > 1e-12 then size else greatest(1e-12, size, 1e0) end as scale from (
        select {keys}, max(y) as pmax, median(abs(y - med)) as mad, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) as iqr, avg(abs(y)) as size
        from (select *, median(y) over (partition by {keys}) as med from {p}_past) group by {keys})""",
        f"{p}_past",
    )
    fragment(f"{p}_pair", f"select {keys}, pos, a.y, f.mean, f.lower, f.upper from {actual} a join {forecast} f using ({keys}, pos) where a.part = 'horizon'", actual, forecast)
    fragment(
        f"{p}_pred",
        f"""select *, round_even((rpa + rqa + mia) / 3, 4) as predictability from (
        select {keys}, case when ymax = 0 and fmax = 0 then 0e0 when pmax = 0 then 1e0 else 1 - round_even(rel, 4) end as rpa,
          case when ymax = 0 and fmax = 0 then 0e0 when pmax = 0 then 1e0 else 1 - round_even(tot / (tot + greatest(1e-12, n * scale) + 1e-12), 4) end as rqa,
          case when sy = sl and sl = su then 0e0 else 1 - miss end as mia
        from (select {keys}, min(scale) as scale, min(pmax) as pmax, max(y) as ymax, max(mean) as fmax, count(*) as n, avg(abs(y - mean) / (abs(y - mean) + scale + 1e-12)) as rel,
          abs(sum(y) - sum(mean)) as tot, sum(y) as sy, sum(lower) as sl, sum(upper) as su,
          avg(case when y < least(lower, upper) or y > greatest(lower, upper) then 1e0 else 0e0 end) as miss
          from {p}_pair join {p}_scale using ({keys}) group by {keys}))""",
        f"{p}_pair", f"{p}_scale",
    )
    fragment(
        f"{p}_err",
        f"""select {keys}, coalesce(avg(case when abs(y) + abs(mean) >= 1e-12 then abs(y - mean) / (abs(y) + abs(mean)) end), case when sum(y) = 0 and sum(mean) = 0 then 0e0 else 1e0 end) as smape,
        avg(abs(y - mean)) as mae, sqrt(avg((y - mean) * (y - mean))) as rmse from {p}_pair group by {keys}""",
        f"{p}_pair",
    )
    if not residual_tests:
        return
    r = f"{p}_res"
    fragment(r, f"select {keys}, pos, y - mean as y from {p}_pair", f"{p}_pair")
    fragment(
        f"{r}_clean",
        f"select *, row_number() over (partition by {keys} order by pos) - 1 as i, count(*) over (partition by {keys}) as n, y - avg(y) over (partition by {keys}) as e from {r}", r,
    )
    bds_fragments(r, keys)
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    fragment(
        f"{r}_ljb",
        f"""select {keys}, n * (n + 2e0) * sum(g * g / (n - k)) / (v * v) as q, cast(least(20, greatest(1, n // 4)) as integer) as lags from (
        select *, sum(case when k = 0 then g end) over (partition by {keys}) as v from (
          select {a_keys}, k, min(a.n) as n, sum(a.e * b.e) as g from {r}_clean a join (select unnest(range(0, 21)) as k) on a.i >= k join {r}_clean b on {on} and b.i = a.i - k group by {a_keys}, k))
        where k between 1 and least(20, greatest(1, n // 4)) group by {keys}, n, v""",
        f"{r}_clean",
    )
    fragment(
        f"{r}_runs",
        f"""select {keys}, n1, n2, case when var > 0 then (runs - (2 * n1 * n2 / (n1 + n2) + 1)) / sqrt(var) end as z from (
        select *, case when n1 + n2 > 1 then 2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2 - 1) * (n1 + n2)) end as var from (
        select {keys}, cast(sum(case when y > 0 then 1 else 0 end) as double) as n1, cast(sum(case when y < 0 then 1 else 0 end) as double) as n2,
          1e0 + sum(case when prev is not null and sign(y) <> sign(prev) then 1 else 0 end) as runs
        from (select *, lag(y) over (partition by {keys} order by i) as prev from {r}_clean where y <> 0) group by {keys}))""",
        f"{r}_clean",
    )
    guard = lambda v: f"case when n < 2 then 1e0 when s = 0 then 1e0 when lo = hi then 0e0 else coalesce({v}, 1e0) end"
    fragment(
        f"{p}_eff",
        f"""select *, round_even((bds + ljb + runs) / 3, 4) as effectiveness from (
        select {keys}, {guard(normal_two_sided_sql('bz'))} as bds, {guard(chi2_tail_sql('q', 'lags'))} as ljb,
        {guard(f"case when n1 + n2 < 2 then 1e0 when n1 = 0 or n2 = 0 then 0e0 when rz is null then 1e0 else round_even({normal_two_sided_sql('rz')}, 4) end")} as runs, bz, q, rz
        from (select {keys}, count(*) as n, sum(y) as s, min(y) as lo, max(y) as hi from {r} group by {keys})
        join (select {keys}, z as bz from {r}_bds) using ({keys}) left join {r}_ljb using ({keys}) left join (select {keys}, n1, n2, z as rz from {r}_runs) using ({keys}))""",
        r, f"{r}_bds", f"{r}_ljb", f"{r}_runs",
    )
    fragment(
        f"{p}_eval",
        f"""select {keys}, u.m as metric, u.v as value from (select {keys}, unnest([{', '.join(f"struct_pack(m := '{m}', v := {m})" for m in mt.ALL_METRICS)}]) as u
        from {p}_pred join {p}_eff using ({keys})) where u.v is not null""",
        f"{p}_pred", f"{p}_eff",
    )


def meanfill_fragment(name: str, actual: str, keys: str, h: int) -> None:
    """Mean forecast of the past part of ``actual`` for its next h positions."""
    fragment(
        name,
        f"""select {keys}, last + k as pos, m as mean, round_even(m - 0.95e0 * m, 4) as lower, round_even(m + 0.95e0 * m, 4) as upper, m, last
        from (select {keys}, avg(y) as m, max(pos) as last from {actual} where part = 'past' group by {keys}), (select unnest(range(1, {h + 1})) as k)""",
        actual,
    )


meanfill_fragment("p25_mf", "p25_hold", "series_id", H)
score_fragments("p25_mf", "p25_hold", "p25_mf", "series_id")
fragment("p125_hold", f"select *, case when row_number() over (partition by series_id order by pos desc) <= {H} then 'horizon' else 'past' end as part from p125", "p125")
meanfill_fragment("p125_mf", "p125_hold", "series_id", H)
score_fragments("p125_mf", "p125_hold", "p125_mf", "series_id")


def held_out(spark, d, name="p25", h=H):
    """(rows with part, history rows) of a panel with its last h steps held out."""
    rows = cl.holdout_split(panel(spark, d, name), h)
    return rows, rows.where("part = 'past'")


def meanfill_units(spark, d, name="p25"):
    rows, past = held_out(spark, d, name)
    return mt.build_units(rows, fc.fc_meanfill(past, H))


def _metric(name: str, source: str, places: int = 6) -> None:
    @query(f"metric_{name}" if name not in mt.SCORES else f"score_{name}", sql(f"select series_id, {R(name, places)} as value from p125_mf_{source}", f"p125_mf_{source}"))
    def _(spark, d):
        return mt.score_units(meanfill_units(spark, d, "p125"), metrics=[name]).select("series_id", rnd(name, places).alias("value"))


for _m in ["smape"]:
    _metric(_m, "err")
for _m in ["mae", "rmse"]:
    _metric(_m, "err", 3)
for _m in ["rpa", "rqa", "mia", "predictability"]:
    _metric(_m, "pred")
for _m in ["runs", "effectiveness"]:
    _metric(_m, "eff")


@query("metric_bds", sql(f"select series_id, {R('bz')} as statistic, {R('bds')} as value from p125_mf_eff", "p125_mf_eff"))
def _(spark, d):
    return mt.with_effectiveness(meanfill_units(spark, d, "p125")).select("series_id", rnd("bds_stat").alias("statistic"), rnd("bds").alias("value"))


@query("metric_ljb", sql(f"select series_id, lags, {R('q')} as statistic, {R('ljb')} as value from p125_mf_eff join (select series_id, lags from p125_mf_res_ljb) using (series_id)", "p125_mf_eff"))
def _(spark, d):
    return mt.with_effectiveness(meanfill_units(spark, d, "p125")).select("series_id", F.col("ljb_lags").alias("lags"), rnd("ljb_stat").alias("statistic"), rnd("ljb").alias("value"))


@query("evaluate_forecasts", sql(f"select series_id, metric, {R('value')} as value from p125_mf_eval", "p125_mf_eval"))
def _(spark, d):
    rows, past = held_out(spark, d, "p125")
    return mt.evaluate_forecasts(rows, fc.fc_meanfill(past, H)).withColumn("value", rnd("value"))


FC_COLS = ["mean", "lower", "upper", "fit", "fit_lower", "fit_upper"]


def forecast_rows(f, places=2):
    return f.select("series_id", "model_key", "pos", "ts", *[rnd(x, places).alias(x) for x in FC_COLS])


@query(
    "fc_meanfill",
    sql(f"""select series_id, concat('MEANFILL|{H}|', series_id) as model_key, p.pos, ts, {R('mean', 4)} as mean, lower, upper, null as fit, null as fit_lower, null as fit_upper
    from p25_mf f join p25 p using (series_id, pos)
    union all select series_id, concat('MEANFILL|{H}|', series_id), p.pos, ts, null, null, null, {R('m', 4)}, lower, upper from p25_hold p join (select distinct series_id, m, lower, upper from p25_mf) using (series_id) where part = 'past'""",
    "p25_mf", "p25_hold"),
)
def _(spark, d):
    return forecast_rows(fc.fc_meanfill(held_out(spark, d)[1], H, step="week"), 4)


# ---- exponential smoothing ----------------------------------------------------------------------

fragment("p25_ys", "select series_id, list(y order by pos) as ys, max(pos) as last from p25_hold where part = 'past' group by 1", "p25_hold")


_G = "(select round(0.1e0 * unnest(range(1, 10)), 1) as {})"
fragment("ses_cand", f"select series_id, ys, last, a from p25_ys, {_G.format('a')}", "p25_ys")
fragment(
    "ses_path",
    """select series_id, a, ys, last, 1 as t, ys[1] as level, null::double as fit, 0e0 as sse from ses_cand
    union all select series_id, a, ys, last, t + 1, a * ys[t + 1] + (1 - a) * level, level, sse + (ys[t + 1] - level) * (ys[t + 1] - level) from ses_path where t < len(ys)""",
    "ses_cand",
)
fragment("ses_best", "select series_id, arg_min(a, struct_pack(s := sse, a := a)) as a from ses_path where t = len(ys) group by 1", "ses_path")
fragment(
    "holt_cand",
    f"select series_id, ys, last, a, b from p25_ys, {_G.format('a')}, {_G.format('b')}", "p25_ys",
)
fragment(
    "holt_path",
    """select series_id, a, b, ys, last, 2 as t, ys[2] as level, ys[2] - ys[1] as trend, null::double as fit, 0e0 as sse from holt_cand
    union all select series_id, a, b, ys, last, t + 1, nl, b * (nl - level) + (1 - b) * trend, base, sse + (ys[t + 1] - base) * (ys[t + 1] - base)
    from (select *, level + trend as base, a * ys[t + 1] + (1 - a) * (level + trend) as nl from holt_path where t < len(ys))""",
    "holt_cand",
)
fragment("holt_best", "select series_id, arg_min(struct_pack(a := a, b := b), struct_pack(s := sse, a := a, b := b)) as w from holt_path where t = len(ys) group by 1", "holt_path")
_C = "(select unnest([0.1e0, 0.5e0, 0.9e0]) as {})"
M = 52
fragment("hw_cand", f"select series_id, ys, last, a, g, list_sum(ys[1:{M}]) / {M} as l0 from p25_ys, {_C.format('a')}, {_C.format('g')}", "p25_ys")
fragment(
    "hw_path",
    f"""select series_id, a, g, ys, last, {M} as t, l0 as level, list_transform(ys[1:{M}], lambda x: x - l0) as season, null::double as fit, 0e0 as sse from hw_cand
    union all select series_id, a, g, ys, last, t + 1, a * (y - s) + (1 - a) * level, list_concat(season[2:], [g * (y - level) + (1 - g) * s]), level + s, sse + (y - level - s) * (y - level - s)
    from (select *, ys[t + 1] as y, season[1] as s from hw_path where t < len(ys))""",
    "hw_cand",
)
fragment("hw_best", "select series_id, arg_min(struct_pack(a := a, g := g), struct_pack(s := sse, a := a, g := g)) as w from hw_path where t = len(ys) group by 1", "hw_path")


def ets_oracle(p: str, join: str, mean: str, start: int, key: str) -> str:
    chosen = f"(select p.* from {p}_path p join {p}_best w on w.series_id = p.series_id and {join})"
    return f"""select series_id, concat('{key}|{H}|', series_id) as model_key, last + k as pos, ts, {R('mean')} as mean, {R('mean + q.lo', 4)} as lower, {R('mean + q.hi', 4)} as upper,
      null as fit, null as fit_lower, null as fit_upper
    from (select c.*, k, {mean} as mean from {chosen} c, (select unnest(range(1, {H + 1})) as k) where t = len(ys))
    join (select series_id, quantile_cont(ys[t] - fit, 0.025) as lo, quantile_cont(ys[t] - fit, 0.975) as hi from {chosen} where fit is not null group by 1) q using (series_id)
    join p25 using (series_id) where p25.pos = last + k
    union all select series_id, concat('{key}|{H}|', series_id), p.pos, ts, null, null, null, {R('coalesce(fit, y)', 4)}, {R('coalesce(fit, y) + q.lo', 4)}, {R('coalesce(fit, y) + q.hi', 4)}
    from p25_hold p left join (select series_id, t - 1 as pos, fit from {chosen} where fit is not null) using (series_id, pos)
    join (select series_id, quantile_cont(ys[t] - fit, 0.025) as lo, quantile_cont(ys[t] - fit, 0.975) as hi from {chosen} where fit is not null group by 1) q using (series_id)
    where part = 'past'"""


def _ets_rows(spark, d, **params):
    f = fc.fc_ets(held_out(spark, d)[1], H, step="week", **params)
    return f.select("series_id", "model_key", "pos", "ts", rnd("mean").alias("mean"), *[rnd(x, 4).alias(x) for x in FC_COLS[1:]])


@query("fc_ets", sql(ets_oracle("ses", "w.a = p.a", "level", 1, "ETS(trend=None,seasonal=None,m=52)"), "p25_hold", "ses_best", recursive=True))
def _(spark, d):
    return _ets_rows(spark, d)


@query("fc_ets_trend", sql(ets_oracle("holt", "w.w.a = p.a and w.w.b = p.b", "level + k * trend", 2, "ETS(trend=add,seasonal=None,m=52)"), "p25_hold", "holt_best", recursive=True))
def _(spark, d):
    return _ets_rows(spark, d, trend="add")


@query("fc_ets_seasonal", sql(ets_oracle("hw", "w.w.a = p.a and w.w.g = p.g", "level + season[k]", M, "ETS(trend=None,seasonal=add,m=52)"), "p25_hold", "hw_best", recursive=True))
def _(spark, d):
    return _ets_rows(spark, d, seasonal="add", m=M)


@query("fc_ets_full")
def _(spark, d):
    return _ets_rows(spark, d, trend="add", seasonal="mul", m=4)
