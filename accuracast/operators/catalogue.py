"""Catalogue of simple series characteristics (public definitions, Christ et al. 2018).

Everything here is an aggregate over values, lags, ranks or positions of a series, so the whole
catalogue is two window sorts and one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accuracast.functions import columns as c
from accuracast.functions.columns import ID, over, whole
from accuracast.operators.features import levinson

QUANTILES = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]
SIGMAS = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 6.0, 7.0, 10.0]
PEAK_SUPPORT = [1, 3, 5, 10]
MAX_LAG = 9
PARTIAL_LAGS = 5
CHUNKS = 10
BINS = 10
MASS = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]


def tag(x: float) -> str:
    return str(x).replace(".", "_")


def catalogue_rows(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Rows with neighbours, moments, run lengths and cumulative mass."""
    w, g = over(keys), whole(keys)
    clean = panel.where(F.col("y").isNotNull()).select(*keys, "pos", "y")
    reach = max(PEAK_SUPPORT)
    rows = clean.select(
        "*", (F.row_number().over(w).cast("bigint") - 1).alias("i"), F.count("y").over(g).alias("n"), F.avg("y").over(g).alias("mu"),
        F.coalesce(F.stddev_pop("y").over(g), F.lit(0.0)).alias("sd"), F.median("y").over(g).alias("med"), F.min("y").over(g).alias("lo"), F.max("y").over(g).alias("hi"),
        F.sum(F.abs("y")).over(g).alias("mass"), F.sum(F.abs("y")).over(w).alias("cum"), F.count(F.lit(1)).over(whole([*keys, "y"])).alias("copies"),
        *[F.lag("y", k).over(w).alias(f"l{k}") for k in range(1, reach + 1)], *[F.lead("y", k).over(w).alias(f"r{k}") for k in range(1, reach + 1)],
    )
    above, below = F.col("y") > F.col("mu"), F.col("y") < F.col("mu")
    # gaps and islands: the position less the count of hits so far is constant within a run
    rows = rows.select(
        "*", (F.col("i") - F.sum(above.cast("int")).over(w)).alias("run_above"), (F.col("i") - F.sum(below.cast("int")).over(w)).alias("run_below"),
    )
    return rows.select(
        "*", F.when(above, F.count(F.lit(1)).over(whole([*keys, "run_above", (F.col("y") > F.col("mu")).alias("a")]))).alias("strike_above"),
        F.when(below, F.count(F.lit(1)).over(whole([*keys, "run_below", (F.col("y") < F.col("mu")).alias("b")]))).alias("strike_below"),
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def catalogue_aggregates() -> dict[str, Column]:
    y, l1, r1, n = F.col("y"), F.col("l1"), F.col("r1"), F.count("y")
    d = y - l1
    mu, sd = F.avg("y"), F.stddev_pop("y")
    e = y - F.col("mu")
    out = {
        "abs_energy": F.sum(y * y), "absolute_sum_of_changes": F.coalesce(F.sum(F.abs(d)), F.lit(0.0)), "mean_abs_change": F.avg(F.abs(d)), "mean_change": F.avg(d),
        "mean_second_derivative_central": F.avg((r1 - 2 * y + l1) / 2.0), "mean": mu, "variance": F.var_pop("y"), "standard_deviation": sd,
        "variation_coefficient": ratio(sd, mu), "root_mean_square": F.sqrt(F.avg(y * y)), "median": F.max("med"), "minimum": F.min("y"), "maximum": F.max("y"),
        "sum_values": F.sum("y"), "length": n.cast("double"),
        "count_above_mean": F.sum((y > F.col("mu")).cast("double")), "count_below_mean": F.sum((y < F.col("mu")).cast("double")),
        "longest_strike_above_mean": F.coalesce(F.max("strike_above"), F.lit(0)).cast("double"), "longest_strike_below_mean": F.coalesce(F.max("strike_below"), F.lit(0)).cast("double"),
        "first_location_of_maximum": F.min(F.when(y == F.col("hi"), F.col("i"))) / n, "last_location_of_maximum": (F.max(F.when(y == F.col("hi"), F.col("i"))) + 1) / n,
        "first_location_of_minimum": F.min(F.when(y == F.col("lo"), F.col("i"))) / n, "last_location_of_minimum": (F.max(F.when(y == F.col("lo"), F.col("i"))) + 1) / n,
        "has_duplicate": F.max((F.col("copies") > 1).cast("double")), "has_duplicate_max": F.max(F.when(y == F.col("hi"), (F.col("copies") > 1).cast("double"))),
        "has_duplicate_min": F.max(F.when(y == F.col("lo"), (F.col("copies") > 1).cast("double"))),
        "number_crossing_mean": F.coalesce(F.sum(((y > F.col("mu")) != (l1 > F.col("mu"))).cast("double")), F.lit(0.0)),
        "number_crossing_0": F.coalesce(F.sum(((y > 0) != (l1 > 0)).cast("double")), F.lit(0.0)),
        "range_count_one_sigma": F.sum(((y >= F.col("mu") - F.col("sd")) & (y < F.col("mu") + F.col("sd"))).cast("double")), "value_count_0": F.sum((y == 0).cast("double")),
        "linear_trend_slope": F.regr_slope("y", "i"), "linear_trend_intercept": F.regr_intercept("y", "i"), "linear_trend_rvalue": c.corr("y", "i"),
        "cid_ce": F.sqrt(F.sum(d * d)), "cid_ce_normalized": ratio(F.sqrt(F.sum(d * d)), sd),
        "sum_of_reoccurring_data_points": F.sum(F.when(F.col("copies") > 1, y).otherwise(0.0)),
        "sum_of_reoccurring_values": F.sum(F.when(F.col("copies") > 1, y / F.col("copies")).otherwise(0.0)),
        "percentage_of_reoccurring_points": F.avg((F.col("copies") > 1).cast("double")),
        "percentage_of_reoccurring_values": ratio(F.sum(F.when(F.col("copies") > 1, 1.0 / F.col("copies")).otherwise(0.0)), F.sum(1.0 / F.col("copies"))),
        "large_standard_deviation": (sd > 0.25 * (F.max("y") - F.min("y"))).cast("double"),
        "symmetry_looking": (F.abs(mu - F.max("med")) < 0.05 * (F.max("y") - F.min("y"))).cast("double"),
        "ratio_value_number_to_length": F.sum(1.0 / F.col("copies")) / n,
    }
    q = F.percentile("y", QUANTILES)
    for i, level in enumerate(QUANTILES):
        out[f"quantile_{tag(level)}"] = F.get(q, F.lit(i))
    for r in SIGMAS:
        out[f"ratio_beyond_r_sigma_{tag(r)}"] = F.avg((F.abs(e) > r * F.col("sd")).cast("double"))
    for s in PEAK_SUPPORT:
        higher = (y > l1) & (y > r1)
        for k in range(2, s + 1):
            higher = higher & (y > F.col(f"l{k}")) & (y > F.col(f"r{k}"))
        out[f"number_peaks_{s}"] = F.sum(F.coalesce(higher, F.lit(False)).cast("double"))
    for k in range(1, MAX_LAG + 1):
        # autocovariance over the n-k pairs against the population variance
        out[f"autocorrelation_{k}"] = ratio(F.sum(e * (F.col(f"l{k}") - F.col("mu"))) / (n - k), F.var_pop("y"))
    for k in range(1, 4):
        a, b, z = F.col(f"r{2 * k}"), F.col(f"r{k}"), y
        out[f"time_reversal_asymmetry_{k}"] = F.avg(a * a * b - b * z * z)
    for j in range(CHUNKS):
        size = F.ceil(F.col("n") / CHUNKS)
        mine = (F.col("i") >= j * size) & (F.col("i") < (j + 1) * size)
        out[f"energy_ratio_by_chunks_{j}"] = ratio(F.sum(F.when(mine, y * y).otherwise(0.0)), F.sum(y * y))
    for level in MASS:
        out[f"index_mass_quantile_{tag(level)}"] = (F.min(F.when((F.col("mass") > 0) & (F.col("cum") / F.col("mass") >= level), F.col("i"))) + 1) / n
    return out


def histogram_entropy(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entropy of ten equal bins, and of ordinal patterns of three values."""
    span = F.col("hi") - F.col("lo")
    b = F.when(span > 0, F.least(F.lit(BINS - 1), F.floor((F.col("y") - F.col("lo")) / span * BINS).cast("int"))).otherwise(0)
    y, r1, r2 = F.col("y"), F.col("r1"), F.col("r2")
    pattern = F.when(r2.isNotNull(), (y <= r1).cast("int") * 4 + (y <= r2).cast("int") * 2 + (r1 <= r2).cast("int") + 100)
    kinds = rows.select(*keys, F.explode(F.array(F.struct(F.lit("bin").alias("k"), b.cast("int").alias("v")), F.struct(F.lit("pattern").alias("k"), pattern.cast("int").alias("v")))).alias("s"))
    counts = kinds.select(*keys, "s.k", "s.v").where(F.col("v").isNotNull()).groupBy(*keys, "k", "v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    h = lambda k: F.log(F.sum(F.when(F.col("k") == k, F.col("c")))) - F.sum(F.when(F.col("k") == k, F.col("c") * F.log("c"))) / F.sum(F.when(F.col("k") == k, F.col("c")))
    return counts.groupBy(*keys).agg(h("bin").alias("binned_entropy_10"), h("pattern").alias("permutation_entropy_3"))


def chunk_trend(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Linear trend over means of chunks of ten values."""
    chunks = rows.groupBy(*keys, F.floor(F.col("i") / 10).alias("j")).agg(F.avg("y").alias("m"))
    return chunks.groupBy(*keys).agg(F.regr_slope("m", "j").alias("agg_linear_trend_slope"), F.regr_intercept("m", "j").alias("agg_linear_trend_intercept"))


def first_digits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of the first-digit distribution with Benford's law."""
    a = F.abs("y")
    digit = F.when(a > 0, F.least(F.lit(9), F.floor(a / F.pow(F.lit(10.0), F.floor(F.log10(a))) + 1e-9).cast("int")))
    counts = rows.select(*keys, digit.alias("g")).groupBy(*keys).agg(
        *[F.avg(F.when(F.col("g") == k, 1.0).otherwise(0.0)).alias(f"g{k}") for k in range(1, 10)]
    )
    wide = counts.select(*keys, F.explode(F.array(*[F.struct(F.col(f"g{k}").alias("o"), F.lit(math.log10(1 + 1 / k)).alias("p")) for k in range(1, 10)])).alias("s"))
    return wide.groupBy(*keys).agg(c.corr("s.o", "s.p").alias("benford_correlation"))


def with_partial_autocorrelation(wide: DataFrame) -> DataFrame:
    """Adds partial_autocorrelation_1 .. _5 from the autocorrelations; NULL from half the length on, where too few pairs are left."""
    r = levinson(wide.withColumns({f"_r{k}": F.col(f"autocorrelation_{k}") for k in range(1, PARTIAL_LAGS + 1)}), PARTIAL_LAGS)
    return r.withColumns({f"partial_autocorrelation_{k}": F.when(F.floor(F.col("length") / 2) > k, F.col(f"_f{k}_{k}")) for k in range(1, PARTIAL_LAGS + 1)})


def feature_catalogue(panel: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Long form: keys, feature, value; every series carries every feature."""
    rows = catalogue_rows(panel, keys)
    aggs = catalogue_aggregates()
    wide = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    wide = with_partial_autocorrelation(wide).select(*keys, *aggs, *[f"partial_autocorrelation_{k}" for k in range(1, PARTIAL_LAGS + 1)])
    extra = [histogram_entropy(rows, keys), chunk_trend(rows, keys), first_digits(rows, keys)]
    names = [x for x in wide.columns if x not in keys]
    for part in extra:
        names += [x for x in part.columns if x not in keys]
        wide = wide.join(part, list(keys), "left")
    wide = wide.select(*keys, *[c.finite(F.col(x).cast("double")).alias(x) for x in names])
    return wide.unpivot(list(keys), names, "feature", "value")
