"""Regular panels out of fact tables.

A panel has one row per (series, calendar step): ``series_id, pos, ts, y``. Facts are summed by
(series, step) with map-side partial aggregation before the only wide shuffle, so a series that
holds a third of all facts arrives as at most one partial row per step and task. After that a
series is bounded by the length of the calendar, whatever the size of the fact table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accuracast.session import written

STEPS = {
    "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS",
    "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 12 MONTHS",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truncated(step: str, ts: Column | str) -> Column:
    """Start of the calendar step, without a zone."""
    return F.date_trunc(step, ts).cast("timestamp_ntz")


def aggregate_facts(facts: DataFrame, step: str) -> DataFrame:
    """(series_id, ts, y) facts → one sum per (series, calendar step), cents exact."""
    return facts.groupBy("series_id", truncated(step, F.col("ts")).alias("ts")).agg(F.bround(F.sum("y"), 2).alias("y"))


def fill_calendar(sums: DataFrame, step: str) -> DataFrame:
    """Put every series on the common calendar, absent steps are 0."""
    bounds = sums.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    ids = sums.select("series_id").distinct()
    calendar = ids.select("series_id", F.posexplode(F.sequence(lo, hi, F.expr(STEPS[step]))).alias("pos", "ts"))
    return calendar.join(sums, ["series_id", "ts"], "left").select(
        "series_id", F.col("pos").cast("bigint").alias("pos"), "ts", F.coalesce("y", F.lit(0.0)).alias("y")
    )


def panel_from_events(facts: DataFrame, step: str) -> DataFrame:
    """Facts → regular panel, written once to the shared folder.

    Bounds, ids and values are three readers of the sums, and every operator downstream reads the
    panel several times. Keeping the sums while the panel is written means the facts are scanned
    exactly once, and a lost executor later re-reads the small panel, not the facts.
    """
    sums = aggregate_facts(facts, step).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return written(fill_calendar(sums, step), "panel")
    finally:
        sums.unpersist()


def order_facts(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    """Order totals by a key of the ordering customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", key.alias("series_id"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "series_id", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y")
    )


def facts(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    """Facts and calendar step of a named panel."""
    if name == "p5":
        return order_facts(spark, sf_dir, F.col("c_mktsegment")), "week"
    if name == "p25":
        return order_facts(spark, sf_dir, F.col("c_nationkey").cast("string")), "week"
    if name == "p125":
        return order_facts(spark, sf_dir, F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")), "week"
    if name == "pe":
        events = table(spark, sf_dir, "events")
        return events.select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y")), "hour"
    if name == "pl":
        items = table(spark, sf_dir, "lineitem")
        return items.select(
            F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("y")
        ), "week"
    raise KeyError(name)


def sparse(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named panel before gaps are filled: non-empty steps only."""
    return aggregate_facts(*facts(spark, sf_dir, name))


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return panel_from_events(*facts(spark, sf_dir, name))
