"""Exact order statistics and ranks of groups of any size.

``percentile`` keeps every distinct value of a group in one task and a rank window sorts a whole
group in one task. Both are fine for a series, whose length the calendar bounds, and wrong for
"all series of one metric". Here a mergeable sketch cuts each group into value ranges first, counts
are combined map-side, and only one range at a time has to fit a task. Results stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH = 10000
RANGES = 64


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group: keys, one column per quantile, and ``n``."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # sketch weights come from the rows, so it is built on them and not on the distinct values
    slack = 4.0 / SKETCH
    marks = [max(0.0, q - slack) for q in quantiles.values()] + [min(1.0, q + slack) for q in quantiles.values()]
    sketch = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), [float(x) for x in marks], SKETCH).alias("_m"), F.count(F.lit(1)).alias("n")
    )
    rows = counts.join(sketch, keys)
    k = len(quantiles)
    aggs, picks = [F.max("n").alias("n")], []
    for i, (name, q) in enumerate(quantiles.items()):
        lo = F.get("_m", F.lit(i)) if q - slack > 0 else F.lit(float("-inf"))
        hi = F.get("_m", F.lit(k + i)) if q + slack < 1 else F.lit(float("inf"))
        # on small groups the wanted rank may lie one value outside the range, on either side
        inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
        aggs += [
            F.sum(F.when(F.col("_v") < lo, F.col("_c")).otherwise(0)).alias(f"_below{i}"),
            F.sort_array(F.collect_list(F.when(inside, F.struct("_v", "_c")))).alias(f"_in{i}"),
            F.min(F.when(F.col("_v") > hi, F.col("_v"))).alias(f"_next{i}"),
            F.max(F.when(F.col("_v") < lo, F.col("_v"))).alias(f"_prev{i}"),
        ]
        at = (F.col("n") - 1) * F.lit(q)

        def nth(rank, i=i):
            walk = F.aggregate(
                f"_in{i}", F.struct(F.col(f"_below{i}").alias("s"), F.lit(None).cast("double").alias("v")),
                lambda acc, x: F.struct((acc["s"] + x["_c"]).alias("s"), F.when(acc["v"].isNotNull(), acc["v"]).when(acc["s"] + x["_c"] > rank, x["_v"]).alias("v")),
                lambda acc: acc["v"],
            )
            return F.when(rank < F.col(f"_below{i}"), F.col(f"_prev{i}")).otherwise(F.coalesce(walk, F.col(f"_next{i}")))

        low = F.floor(at)
        a, b = nth(low), nth(F.least(low + 1, F.col("n") - 1))
        picks.append((a + (b - a) * (at - low)).alias(name))
    return rows.groupBy(*keys).agg(*aggs).select(*keys, *picks, "n")


def distributed_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average rank (1 = smallest) of ``value`` within a group of any size; NULL values get NULL."""
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    cuts = known.groupBy(*keys).agg(F.percentile_approx(F.col(value), [i / RANGES for i in range(1, RANGES)], SKETCH).alias("_cuts"))
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).join(cuts, keys)
    counts = counts.withColumn("_r", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    sizes = counts.groupBy(*keys, "_r").agg(F.sum("_c").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    within = F.sum("_c").over(Window.partitionBy(*keys, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_w", within).join(sizes, [*keys, "_r"]).select(
        *keys, value, (F.coalesce("_before", F.lit(0)) + F.col("_w") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out)
    )
    return df.join(ranked, [*keys, value], "left")
