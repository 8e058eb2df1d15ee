"""Distribution tails, exact order statistics, ranks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accuracast.functions import calendar as cal
from accuracast.functions.scale import distributed_rank, exact_quantiles
from accuracast.functions.stats import adf_p_sql, chi2_tail, kpss_p_sql, normal_two_sided, t_two_sided


def test_normal_tail(spark):
    d = spark.range(0, 900).select((F.col("id") / 100.0).alias("z")).withColumn("p", normal_two_sided("z")).toPandas()
    assert max(abs(p - math.erfc(z / math.sqrt(2))) for z, p in zip(d.z, d.p)) < 1e-14


def test_chi_square_tail(spark):
    d = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (31.410432844230918, 20), (16.918977604620448, 9)], "q double, k int")
    assert [round(r.p, 10) for r in d.withColumn("p", chi2_tail("q", "k")).collect()] == [0.05] * 4


def test_t_tail(spark):
    d = spark.createDataFrame([(12.706204736432095, 1), (2.7764451051977987, 4), (2.2281388519649385, 10), (1.9799304050824413, 121)], "t double, k int")
    assert [round(r.p, 4) for r in d.withColumn("p", t_two_sided(F.col("t"), F.col("k"))).collect()] == [0.05] * 3 + [pytest.approx(0.05, abs=2e-4)]


def test_unit_root_and_kpss_tables(spark):
    d = spark.createDataFrame([(-2.86, 0.463), (-25.0, 0.1), (3.0, 2.0)], "a double, k double").select(F.expr(adf_p_sql("a")).alias("a"), F.expr(kpss_p_sql("k")).alias("k")).collect()
    assert d[0].a == pytest.approx(0.0502, abs=2e-3) and d[1].a == 0.0 and d[2].a == 1.0
    assert [r.k for r in d] == pytest.approx([0.05, 0.10, 0.01])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 25, 1000, 30011])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=n).round(3)
    v[: n // 3] = v[0]  # a third of the rows are copies
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": v}))
    qs = {"a": 0.025, "b": 0.25, "c": 0.3, "d": 0.5, "e": 0.975, "lo": 0.0, "hi": 1.0}
    row = exact_quantiles(df, ["g"], "v", qs).first()
    assert row.n == n
    for name, q in qs.items():
        assert row[name] == pytest.approx(np.quantile(v, q), abs=1e-12)


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_distributed_rank(spark, n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, max(2, n // 4), size=n).astype(float)
    v[: n // 3] = 1.0
    d = distributed_rank(spark.createDataFrame(pd.DataFrame({"g": "a", "i": range(n), "v": v})), ["g"], "v").toPandas().sort_values("i")
    assert np.allclose(d["rank"], pd.Series(v).rank())


def test_ties_share_ranks(spark):
    d = distributed_rank(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None)], "g string, v double"), ["g"], "v").toPandas()
    assert sorted(d["rank"].dropna()) == [1.5, 1.5, 3.0] and d["rank"].isna().sum() == 1


def test_periods_and_seasons(spark):
    d = spark.createDataFrame([("W-MON",), ("2W",), ("min",), ("QS",), ("H",), ("XX",)], "f string")
    r = d.select(cal.periods_per_year(F.col("f")).alias("p"), cal.season_length(F.col("f"), 9).alias("s")).collect()
    assert [x.p for x in r] == [52, 26, 525600, 4, 8760, None]
    assert [x.s for x in r] == [52, 9, 60, 4, 24, 9]
