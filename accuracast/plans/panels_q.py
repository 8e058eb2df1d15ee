"""Queries on sources, sinks, panel construction, cleaning, calendars and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from accuracast.functions import calendar as cal
from accuracast.functions.columns import over, rnd
from accuracast.operators import cleaning as cl
from accuracast.operators import windows as win
from accuracast.plans.catalog import R, fragment, query, sql
from accuracast.session import new_path
from accuracast.sources import readers as rd
from accuracast.sources.panels import STEPS, facts, panel, panel_from_events, sparse, table, truncated

H = 26


@query("panel_from_events", sql("select series_id, pos, ts, y from pe", "pe"))
def _(spark, d):
    return panel_from_events(*facts(spark, d, "pe"))


@query("read_panel_csv", sql("select series_id, ts, y from p25", "p25"))
def _(spark, d):
    path = new_path(spark, "wide")
    rd.write_wide_csv(panel(spark, d, "p25"), path, sep=";", decimal=",")
    return rd.read_panel_csv(spark, path)


@query("read_panel_csv_numbers", sql("select series_id, cast(pos as double) as ts, y from p25", "p25"))
def _(spark, d):
    """A numeric index and quoted names; most values before the last rows are whole."""
    path = new_path(spark, "wide")
    wide = panel(spark, d, "p25").groupBy("pos").pivot("series_id").agg(F.first("y")).orderBy("pos")
    wide.write.csv(path, sep="|", header=True, quoteAll=True)
    return rd.read_panel_csv(spark, path)


MIXED_DATES = "case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 'open' else substr(cast(o_orderdate as varchar), 1, 10) end"


@query(
    "date_index",
    f"""with t as (select o_orderkey, {MIXED_DATES} as label, o_orderpriority as other from orders),
    s as (select label as v from t),
    e as (select count(*) as n, count(try_cast(v as double)) as num, count(try_cast(v as timestamp)) as p, count(distinct try_cast(v as timestamp)) as u from s)
    select o_orderkey, case when num < n and p >= 0.8 * n and p >= 5 and u >= 3 then try_cast(label as timestamp) end as ts
    from t, e where try_cast(label as timestamp) is not null""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(MIXED_DATES.replace("varchar", "string")).alias("label"))
    return rd.date_index(rows, "label").select("o_orderkey", "ts")


@query(
    "date_column_test",
    f"""with t as (select o_orderkey, {MIXED_DATES} as label, o_orderpriority as priority, cast(o_custkey as varchar) as customer from orders),
    s as (select * from t),
    u as (select 'label' as column_name, label as v from s union all select 'priority', priority from s union all select 'customer', customer from s),
    e as (select column_name, count(v) as n, count(try_cast(v as double)) as n_numeric,
      count(case when regexp_full_match(v, '\\d{{4}}-\\d\\d-\\d\\d') then try_cast(v as timestamp) end) as n_parsed,
      count(distinct case when regexp_full_match(v, '\\d{{4}}-\\d\\d-\\d\\d') then try_cast(v as timestamp) end) as n_distinct from u group by 1)
    select column_name, n, n_numeric, n_numeric < n and n_parsed >= 0.8 * n and n_parsed >= 5 and n_distinct >= 3 as is_date from e""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.expr(MIXED_DATES.replace("varchar", "string")).alias("label"),
        F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("customer"),
    )
    out = None
    for name in ["label", "priority", "customer"]:
        one = rd.date_stats(rows, name).select(F.lit(name).alias("column_name"), "n", "n_numeric", "is_date")
        out = one if out is None else out.unionAll(one)
    return out


@query(
    "coerce_numeric",
    """select p_partkey, column_name, try_cast(v as double) as y from (
    select p_partkey, unnest(['p_name', 'p_brand', 'p_size', 'p_retailprice']) as column_name,
    unnest([p_name, p_brand, cast(p_size as varchar), cast(cast(p_retailprice as decimal(18,2)) as varchar)]) as v from part)""",
)
def _(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey", "p_name", "p_brand", F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("p_retailprice")
    )
    long = part.unpivot(["p_partkey"], ["p_name", "p_brand", "p_size", "p_retailprice"], "column_name", "v")
    return long.select("p_partkey", "column_name", rd.to_number("v").alias("y"))


@query("unpivot_panel", sql("select series_id, ts, y from p25", "p25"))
def _(spark, d):
    wide = rd.pivot_panel(panel(spark, d, "p25"), "ts")
    return rd.unpivot_panel(wide, "ts")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("pivot_panel", sql("select ts, " + ", ".join(f"max(case when series_id = '{s}' then y end) as {s}" for s in SEGMENTS) + " from p5 group by ts", "p5"))
def _(spark, d):
    return rd.pivot_panel(panel(spark, d, "p5"), "ts", SEGMENTS)


fragment("p125_high", "select series_id, pos, ts, case when y > 400000e0 then y end as y from p125", "p125")


@query("drop_empty_series", sql("select * from p125_high where series_id in (select series_id from p125_high where y is not null)", "p125_high"))
def _(spark, d):
    high = panel(spark, d, "p125").withColumn("y", F.when(F.col("y") > 400000, F.col("y")))
    return cl.drop_empty_series(high)


@query(
    "dedup_keep_last",
    """select series_id, ts, arg_max(y, o) as y from (select cast(c_nationkey as varchar) as series_id, date_trunc('week', o_orderdate) as ts,
    o_totalprice as y, o_orderkey as o from orders join customer on o_custkey = c_custkey) group by 1, 2""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("series_id"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "series_id", truncated("week", "o_orderdate").alias("ts"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("y")
    )
    return cl.dedup_keep_last(rows, "o")


@query("index_positions", sql("select series_id, ts, y, cast(row_number() over (partition by series_id order by ts) - 1 as bigint) as pos from p25_sums", "p25_sums"))
def _(spark, d):
    return cl.index_positions(sparse(spark, d, "p25"))


@query(
    "union_sources",
    sql("select 'orders' as source, series_id, pos, ts, y, null as daily_mean from p5 union all select 'lineitem', series_id, pos, ts, y, " + R("y / 7e0") + " from pl", "p5", "pl"),
)
def _(spark, d):
    items = panel(spark, d, "pl").withColumn("daily_mean", rnd(F.col("y") / 7))
    return rd.union_sources({"orders": panel(spark, d, "p5"), "lineitem": items}).select("source", "series_id", "pos", "ts", "y", "daily_mean")


@query(
    "dataset_summary",
    sql("""select count(distinct ts) as n_rows, count(distinct series_id) as n_series, min(ts) as start_ts, max(ts) as end_ts,
    count(y) as n_values, 'W-MON' as freq from p125""", "p125"),
)
def _(spark, d):
    return cl.dataset_summary(panel(spark, d, "p125"))


@query(
    "select_series",
    sql("select series_id, pos, ts, y from p25 where series_id in (select cast(n_nationkey as varchar) from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA')", "p25"),
)
def _(spark, d):
    chosen = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return cl.select_series(panel(spark, d, "p25"), chosen.select(F.col("n_nationkey").cast("string").alias("series_id")))


@query(
    "parse_model_key",
    """select model_key, split_part(model_key, '|', 1) as model, cast(split_part(model_key, '|', -2) as integer) as horizon, split_part(model_key, '|', -1) as series
    from (select concat('ets|', cast(1 + o_orderkey % 52 as varchar), '|', o_orderpriority) as model_key from orders)""",
)
def _(spark, d):
    keys = table(spark, d, "orders").select(
        F.concat_ws("|", F.lit("ets"), (1 + F.col("o_orderkey") % 52).cast("string"), "o_orderpriority").alias("model_key")
    )
    return cl.parse_model_key(keys)


@query(
    "downsample_stride",
    sql("""select series_id, pos, ts, y from (select *, row_number() over (partition by series_id order by pos) - 1 as i, count(*) over (partition by series_id) as n
    from pe where y > 0) where i % greatest(1, n // 200) = 0""", "pe"),
)
def _(spark, d):
    known = panel(spark, d, "pe").withColumn("y", F.when(F.col("y") > 0, F.col("y")))
    return cl.downsample_stride(known, max_points=200)


# ---- cleaning -----------------------------------------------------------------------------------

fragment("p125_log", "select series_id, pos, ts, case when y > 0 then round_even(ln(y), 6) end as y from p125", "p125")


@query("finite_only", sql("select series_id, pos, ts, y from p125_log where y is not null", "p125_log"))
def _(spark, d):
    # log(0) is minus infinity and 0/0 is NaN on the double level; both must go
    logs = panel(spark, d, "p125").withColumn("y", F.when(F.col("y") > 0, rnd(F.log("y"))).when(F.col("pos") % 2 == 0, F.lit(float("nan"))).otherwise(float("-inf")))
    return cl.finite_only(logs)


LZ = """select series_id, pos, ts, case when y = 0 and max(case when y is null or y <> 0 then 1 end)
over (partition by series_id order by pos rows unbounded preceding) is null then null else y end as y from {}"""
fragment("p125_lz", LZ.format("p125"), "p125")


@query("leading_zeros_to_null", sql("select * from p125_lz", "p125_lz"))
def _(spark, d):
    return cl.leading_zeros_to_null(panel(spark, d, "p125"))


@query(
    "cut_last_non_null",
    sql("""select series_id, pos, ts, case when count(y) over (partition by series_id order by pos rows between current row and unbounded following) > 8 then y end as y
    from (select series_id, pos, ts, case when y > 0 then y end as y from p125)""", "p125"),
)
def _(spark, d):
    return cl.cut_last_non_null(_gaps(spark, d), 8)


def _gaps(spark, d):
    """Panel with unknown instead of zero steps."""
    return panel(spark, d, "p125").withColumn("y", F.when(F.col("y") > 0, F.col("y")))


fragment("p125_gap", "select series_id, pos, ts, case when y > 0 then y end as y from p125", "p125")


@query(
    "ffill_bfill",
    sql("""select series_id, pos, ts, coalesce(last_value(y ignore nulls) over (partition by series_id order by pos rows unbounded preceding),
    first_value(y ignore nulls) over (partition by series_id order by pos rows between current row and unbounded following)) as y from p125_gap""", "p125_gap"),
)
def _(spark, d):
    return cl.ffill_bfill(_gaps(spark, d))


@query("median_fill", sql(f"select series_id, pos, ts, {R('coalesce(y, m, 0e0)')} as y from p125_gap join (select series_id, median(y) as m from p125_gap group by 1) using (series_id)", "p125_gap"))
def _(spark, d):
    return cl.median_fill(_gaps(spark, d)).withColumn("y", rnd("y"))


@query(
    "trim_edge_nulls",
    sql("""select series_id, pos, ts, y from (select series_id, pos, ts, case when y > 400000e0 then y end as y from p125)
    where pos between (select min(pos) from p125 where y > 400000e0) and (select max(pos) from p125 where y > 400000e0)""", "p125"),
)
def _(spark, d):
    return cl.trim_edge_nulls(panel(spark, d, "p125").withColumn("y", F.when(F.col("y") > 400000, F.col("y"))))


fragment(
    "p25_hold",
    f"select *, case when row_number() over (partition by series_id order by pos desc) <= {H} then 'horizon' else 'past' end as part from p25", "p25",
)


@query("holdout_split", sql("select series_id, pos, ts, y, part from p25_hold", "p25_hold"))
def _(spark, d):
    return cl.holdout_split(panel(spark, d, "p25"), H)


@query(
    "difference",
    sql(f"""select series_id, pos, ts, {R('y')} as y from (select series_id, pos, ts, y - lag(y) over (partition by series_id order by pos) as y from
    (select series_id, pos, ts, y - lag(y) over (partition by series_id order by pos) as y from p25)) where y is not null""", "p25"),
)
def _(spark, d):
    return cl.difference(panel(spark, d, "p25"), times=2).withColumn("y", rnd("y"))


@query("seasonal_difference", sql(f"select * from (select series_id, pos, ts, {R('y - lag(y, 52) over (partition by series_id order by pos)')} as y from p25) where y is not null", "p25"))
def _(spark, d):
    return cl.difference(panel(spark, d, "p25"), lag=52).withColumn("y", rnd("y"))


def _mix(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) % 4294967296)"
    return f"xor({x}, {x} >> 16)"


def draw_sql(seed: int, stream: str, i: str) -> str:
    """The hash draw of the bootstrap and the jitter, as oracle text."""
    return f"({_mix(f'((cast({seed * 1000003 + 1} as bigint) + {stream} * 7919 + {i} * 104729) % 4294967296)')} >> 8)"


@query(
    "jitter_constant",
    sql(f"""select series_id, pos, {R("case when lo = hi then sqrt(-2e0 * ln((" + draw_sql(0, "1", "pos") + " + 1) / 16777217e0)) * cos(2e0 * pi() * " + draw_sql(0, "2", "pos") + " / 16777216e0) else 0e0 end")} as noise
    from (select *, min(y) over (partition by series_id) as lo, max(y) over (partition by series_id) as hi
    from (select series_id, pos, case when series_id like '%BUILDING' then 1e0 else y end as y from p125))""", "p125"),
)
def _(spark, d):
    flat = panel(spark, d, "p125").withColumn("y", F.when(F.col("series_id").like("%BUILDING"), 1.0).otherwise(F.col("y")))
    return cl.jitter_constant(flat).select("series_id", "pos", rnd("noise").alias("noise"))


# ---- frequencies --------------------------------------------------------------------------------

fragment(
    "steps",
    " union all ".join(
        f"select '{s}' as series_id, date_trunc('{s}', o_orderdate) as ts from orders group by 2" if s != "hour" else "select 'hour' as series_id, date_trunc('hour', ts) as ts from events group by 2"
        for s in STEPS
    ),
)
fragment(
    "aliases",
    """select series_id, case when n < 3 then null when lo = hi and lo = 604800 then concat('W-', ['MON','TUE','WED','THU','FRI','SAT','SUN'][wd])
    when lo = hi and lo = 86400 then 'D' when lo = hi and lo = 3600 then 'H'
    when ms and mlo = mhi and mlo = 1 then 'MS' when ms and mlo = mhi and mlo = 3 then 'QS' when ms and mlo = mhi and mlo = 12 then 'YS' end as freq
    from (select series_id, count(ts) as n, min(gap) as lo, max(gap) as hi, min(months) as mlo, max(months) as mhi,
      bool_and(extract(day from ts) = 1 and extract(hour from ts) = 0) as ms, min(isodow(ts)) as wd
      from (select series_id, ts, date_sub('second', lag(ts) over w, ts) as gap, date_sub('month', lag(ts) over w, ts) as months
            from steps window w as (partition by series_id order by ts)) group by 1)""",
    "steps",
)


def _aliases(spark, d):
    """Index stamps of the orders at every calendar step, and of the events by hour."""
    out = None
    for step in STEPS:
        stamp = table(spark, d, "events").select("ts") if step == "hour" else table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"))
        one = stamp.select(F.lit(step).alias("series_id"), truncated(step, "ts").alias("ts")).distinct()
        out = one if out is None else out.unionAll(one)
    return cl.infer_frequency(out)


@query("infer_frequency", sql("select * from aliases", "aliases"))
def _(spark, d):
    return _aliases(spark, d)


@query(
    "periods_per_year",
    sql("""select series_id, freq, n, case when freq is not null then cast(greatest(1, round_even(case split_part(freq, '-', 1) when 'W' then 52 when 'D' then 365 when 'H' then 8760 when 'MS' then 12 when 'QS' then 4 when 'YS' then 1 end / cast(n as double), 0)) as integer) end as periods
    from aliases, (select unnest([1, 2, 3]) as n)""", "aliases"),
)
def _(spark, d):
    multiples = _aliases(spark, d).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    alias = F.when(F.col("n") == 1, F.col("freq")).otherwise(F.concat(F.col("n").cast("string"), F.col("freq")))
    return multiples.withColumn("periods", cal.periods_per_year(alias))


@query("season_from_freq", sql("select series_id, freq, coalesce(case split_part(freq, '-', 1) when 'W' then 52 when 'D' then 7 when 'H' then 24 when 'MS' then 12 when 'QS' then 4 when 'YS' then 1 end, 0) as season from aliases", "aliases"))
def _(spark, d):
    return _aliases(spark, d).withColumn("season", cal.season_length(F.col("freq")))


@query("future_index", sql(f"select series_id, p + k as pos, t + to_days(cast(7 * k as integer)) as ts from (select series_id, max(pos) as p, max(ts) as t from p25 group by 1), (select unnest(range(1, {H + 1})) as k)", "p25"))
def _(spark, d):
    return cl.future_index(panel(spark, d, "p25"), H, "week")


@query("periodic_calendar", sql(f"""select series_id, pos, weekday, month, {R('sin(2 * pi() * weekday / 7)')} as weekday_sin, {R('cos(2 * pi() * weekday / 7)')} as weekday_cos,
    {R('sin(2 * pi() * month / 12)')} as month_sin, {R('cos(2 * pi() * month / 12)')} as month_cos
    from (select series_id, pos, cast(isodow(ts) - 1 as integer) as weekday, cast(month(ts) as integer) as month from pe)""", "pe"))
def _(spark, d):
    out = cl.periodic_calendar(panel(spark, d, "pe"))
    return out.select("series_id", "pos", "weekday", "month", *[rnd(c).alias(c) for c in ["weekday_sin", "weekday_cos", "month_sin", "month_cos"]])


# ---- windows ------------------------------------------------------------------------------------


@query(
    "split_windows",
    sql(f"""select series_id, cast(i + 1 as integer) as window_id, pos - i as pos, ts, y, case when pos - i >= l - {H} then 'horizon' else 'past' end as part
    from p25 join (select unnest(range(0, cast(least(5, greatest(1, t - l + 1)) as bigint))) as i, l from
      (select t, greatest({H} + 1, least(t, {H} + cast(round_even(0.8e0 * t, 0) as bigint))) as l from (select count(distinct pos) as t from p25)))
    on pos >= i and pos < i + l""", "p25"),
)
def _(spark, d):
    return win.split_windows(panel(spark, d, "p25"), n=5, h=H)


def tvt_fragments(src: str, n: int, h: int) -> None:
    """Train / val / test windows of a panel, as CTEs."""
    fragment(
        f"{src}_layout",
        f"""select t, len, case when {n} = 1 then 1 else (t - len - {2 * h}) // {3 * max(n - 1, 1)} end as step from
        (select (select max(pos) + 1 from {src}) as t), (select unnest([0, 1, 2, 3]) as j), lateral (select least(208, t) - 52 * j as len)
        where len > 0 and t - len - {2 * h} > 0 and ({n} = 1 or (t - len - {2 * h}) // {3 * max(n - 1, 1)} >= 1) order by len desc limit 1""",
        src,
    )
    fragment(
        f"{src}_bounds",
        f"""select split, cast(i + 1 as integer) as window_id, e - len as a, e as b from (
        select split, i, len, t - k * ({n - 1} * step + {h}) - i * step as e
        from {src}_layout, (select unnest(['test', 'val', 'train']) as split, unnest([0, 1, 2]) as k), (select unnest(range(0, {n})) as i))""",
        f"{src}_layout",
    )
    fragment(
        f"{src}_tvt",
        f"""select split, series_id, window_id, pos - a as pos, ts, y, case when pos >= b - {h} then 'horizon' else 'past' end as part
        from {src} join {src}_bounds on pos >= a and pos < b""",
        src, f"{src}_bounds",
    )


tvt_fragments("p25", 5, H)


@query("train_val_test", sql("select * from p25_tvt", "p25_tvt"))
def _(spark, d):
    return win.train_val_test(panel(spark, d, "p25"), n=5, h=H)


@query("persist_run", sql("select split, count(*) as n, count(distinct series_id) as n_series, " + R("sum(y)", 2) + " as total from p25_tvt group by 1", "p25_tvt"))
def _(spark, d):
    path = new_path(spark, "run")
    p = panel(spark, d, "p25")
    rd.persist_run({"panel": p, "windows": win.train_val_test(p, n=5, h=H)}, path)
    back = rd.load_run(spark, path, "windows")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series_id").alias("n_series"), rnd(F.sum("y"), 2).alias("total"))


@query("load_run", sql("select split, series_id, window_id, pos, ts, y, part from p25_tvt where split = 'val'", "p25_tvt"))
def _(spark, d):
    path = new_path(spark, "run")
    rd.persist_run({"windows": win.train_val_test(panel(spark, d, "p25"), n=5, h=H)}, path)
    return rd.load_run(spark, path, "windows").where("split = 'val'").select("split", "series_id", "window_id", "pos", "ts", "y", "part")


META_H = 26
fragment(
    "p25_meta",
    f"""select series_id, cast(w + 1 as integer) as window_id, pos - w as pos, ts, y, case when pos >= e - {META_H} then 'horizon' else 'past' end as part,
    w as window_start, e - {META_H} - w as window_length
    from (select *, len - (n - w - 1) as e from (select *, least(5, len - {3 * META_H}) as n from (select *, count(*) over (partition by series_id) as len from p25)), (select unnest(range(0, 5)) as w) where w < n)
    where pos >= w and pos < e""",
    "p25",
)


@query("meta_windows", sql("select * from p25_meta", "p25_meta"))
def _(spark, d):
    return win.meta_windows(panel(spark, d, "p25"), n=5, h=META_H)


@query("time_split_80_20", sql("select series_id, pos, ts, y, row_number() over (partition by series_id order by pos desc) <= greatest(1, cast(floor(0.2e0 * count(*) over (partition by series_id)) as bigint)) as is_validation from p25", "p25"))
def _(spark, d):
    return win.time_split(panel(spark, d, "p25"))
