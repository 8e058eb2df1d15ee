"""Rank correlations between features, accuracy and predictor error, and predictor comparisons.

Groups here run over all series, so ranks and quantiles use the range-wise exact helpers and
everything else is sums that combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accuracast.functions.columns import corr, finite
from accuracast.functions.scale import distributed_rank, exact_quantiles
from accuracast.functions.stats import normal_two_sided, t_two_sided
from accuracast.operators.linear import gram, unpack

Z_95 = 1.959963984540054
RIDGE = 1e-6
EDGE = 0.999999
FLAT = 1e-12  # least share of the squared ranks about their mean: one differing value among n leaves some 1 / n
ASSOC = ["split", "family", "method", "predictor", "pred_metric", "metric", "feature", "rho", "pvalue", "n", "ci_low", "ci_high", "controls_k", "nan_policy"]


def fisher_interval(rho: Column, n: Column) -> tuple[Column, Column]:
    r = F.greatest(F.least(rho, F.lit(EDGE)), F.lit(-EDGE))
    z, se = 0.5 * F.log((1 + r) / (1 - r)), 1 / F.sqrt(F.greatest(n - 3.0, F.lit(1.0)))
    back = lambda v: (F.exp(2 * v) - 1) / (F.exp(2 * v) + 1)
    ok = (n >= 4) & rho.isNotNull()
    return F.when(ok, back(z - Z_95 * se)), F.when(ok, back(z + Z_95 * se))


def spearman(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, rho (two places), pvalue, n, ci_low, ci_high over complete pairs."""
    keys = list(keys)
    p = pairs.select(*keys, finite(x).alias("x"), finite(y).alias("y"))
    full = p.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = distributed_rank(distributed_rank(full, keys, "x", "rx"), keys, "y", "ry")
    g = ranked.groupBy(*keys).agg(corr("rx", "ry").alias("r"), F.count(F.lit(1)).alias("n"))
    g = p.select(*keys).distinct().join(g, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = g.withColumn("r", F.when((F.col("n") >= 3) & F.col("r").isNotNull(), F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0))))
    dof = (F.col("n") - 2).cast("double")
    inside = F.abs("r") < 1 - 1e-15
    g = g.withColumn("t", F.when(inside, F.col("r") * F.sqrt(dof / ((1 + F.col("r")) * (1 - F.col("r"))))))
    p_value = F.when(F.col("r").isNotNull(), F.when(inside, t_two_sided(F.col("t"), F.greatest(dof, F.lit(1.0)).cast("int"))).otherwise(0.0))
    g = g.withColumns({"rho": F.bround("r", 2), "pvalue": p_value})
    low, high = fisher_interval(F.col("rho"), F.col("n"))
    return g.select(*keys, "rho", "pvalue", "n", low.alias("ci_low"), high.alias("ci_high"))


def partial_udf(k: int):
    """Gram of [1, ranks of k features, rank of y] → per feature the ridge-residual correlation with y.

    The sums are centred first: rounding of a constant column would else pass for a correlation.
    """

    def run(grams: pd.Series) -> pd.Series:
        out = []
        for flat in grams:
            m = unpack(np.asarray(flat, dtype=float), k + 2)
            res, yi = [], k + 1
            n, squares = m[0, 0], np.diagonal(m).copy()
            m[1:, 1:] -= np.outer(m[0, 1:], m[0, 1:]) / n
            still = np.diagonal(m) <= FLAT * squares
            still[0] = False
            m[0, 1:] = m[1:, 0] = m[still] = m[:, still] = 0.0
            for j in range(1, k + 1):
                x = [i for i in range(k + 1) if i != j]
                a = m[np.ix_(x, x)]
                beta = {t: np.linalg.solve(a + RIDGE * np.eye(len(x)), m[x, t]) for t in (j, yi)}

                def cross(s, t):
                    bs, bt = beta[s], beta[t]
                    raw = m[s, t] - bs @ m[x, t] - bt @ m[x, s] + bs @ a @ bt
                    sums = [m[0, q] - beta[q] @ m[x, 0] for q in (s, t)]
                    return raw - sums[0] * sums[1] / m[0, 0]

                den = np.sqrt(max(cross(j, j), 0.0) * max(cross(yi, yi), 0.0))
                res.append(float(cross(j, yi) / den) if den > 1e-9 and not (still[j] or still[yi]) else 0.0)
            out.append(res)
        return pd.Series(out)

    run.__annotations__ = {"grams": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")


def partial_spearman(rows: DataFrame, keys: Sequence[str], y: str = "y", min_complete: int = 3) -> DataFrame:
    """Rank correlation of every feature with y, the other features held fixed.

    ``rows``: keys, series_id, feature, x, y in long form. Complete series only when a group has at
    least three of them, else gaps become the feature median of the group. All ranks meet in one
    matrix of cross products per group, from which every partial correlation is read.

    A constant control has no effect, a constant feature or y gives 0. ``constants`` counts the columns
    of the group (features and y) that do not vary: with any, the textbook formula has no value.
    """
    keys = list(keys)
    names = sorted(r.feature for r in rows.select("feature").distinct().collect())  # column names
    r = rows.where(finite(y).isNotNull()).select(*keys, "series_id", "feature", finite("x").alias("x"), finite(y).alias("y"))
    wide = r.groupBy(*keys, "series_id", "y").agg(F.count("x").alias("_k"))
    full = wide.groupBy(*keys).agg(F.count(F.when(F.col("_k") == len(names), 1)).alias("_complete"))
    med = exact_quantiles(r, [*keys, "feature"], "x", {"_m": 0.5}).select(*keys, "feature", "_m")
    r = r.join(full, keys).join(wide.select(*keys, "series_id", "_k"), [*keys, "series_id"]).join(med, [*keys, "feature"], "left")
    listwise = F.col("_complete") >= min_complete
    r = r.where(~listwise | (F.col("_k") == len(names)))
    r = r.withColumn("x", F.when(listwise, F.col("x")).otherwise(F.coalesce("x", "_m"))).withColumn("nan_policy", F.when(listwise, "listwise_complete").otherwise("controls_median_impute_on_xy_finite"))
    ranks = distributed_rank(r, [*keys, "feature"], "x", "rx")
    ranks = ranks.groupBy(*keys, "series_id", "nan_policy", "y").pivot("feature", names).agg(F.first("rx"))
    ranks = distributed_rank(ranks, keys, "y", "ry")
    safe = ranks.select(*keys, "nan_policy", "ry", *[F.col(f"`{n}`").alias(f"f{i}") for i, n in enumerate(names)])
    g = gram(safe, "ry", [f"f{i}" for i in range(len(names))], [*keys, "nan_policy"])
    width, spots = len(names) + 2, range(1, len(names) + 2)
    sums = [(F.get("gram", F.lit(i)), F.get("gram", F.lit(i * width - i * (i - 1) // 2))) for i in spots]
    flat = sum((sq - s * s / F.col("n") <= FLAT * sq).cast("int") for s, sq in sums)
    out = g.select(*keys, "nan_policy", "n", flat.alias("constants"), F.posexplode(partial_udf(len(names))("gram")).alias("_i", "rho"))
    out = out.withColumn("feature", F.get(F.array(*[F.lit(n) for n in names]), F.col("_i"))).withColumn("controls_k", F.lit(len(names) - 1))
    df = F.greatest(F.col("n") - F.least(F.col("controls_k"), F.col("n") - 2) - 3, F.lit(1)).cast("double")
    out = out.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho"))).withColumn("_df", df)
    out = out.withColumn("_z", F.when(F.abs("rho") < 1, 0.5 * F.log((1 + F.col("rho")) / (1 - F.col("rho"))) * F.sqrt("_df")))
    p = F.when(F.col("rho").isNull(), None).when(F.abs("rho") >= 1, 0.0).otherwise(normal_two_sided("_z"))
    out = out.withColumn("pvalue", p)
    low, high = fisher_interval(F.col("rho"), F.col("_df") + 3)
    return out.select(*keys, "feature", "rho", "pvalue", "n", low.alias("ci_low"), high.alias("ci_high"), "controls_k", "nan_policy", "constants")


def as_assoc(df: DataFrame, family: str, method: str, **fixed) -> DataFrame:
    """Fill the common association schema."""
    have = set(df.columns)
    defaults = {"controls_k": F.lit(0), "nan_policy": F.lit("pairwise_complete")}
    cols = []
    for name in ASSOC:
        if name == "family":
            cols.append(F.lit(family).alias(name))
        elif name == "method":
            cols.append(F.lit(method).alias(name))
        elif name in have:
            cols.append(F.col(name))
        elif name in fixed:
            cols.append(fixed[name].alias(name))
        else:
            cols.append(defaults.get(name, F.lit(None).cast("string")).alias(name))
    return df.select(*cols)


def _joined(scores: DataFrame, features: DataFrame) -> DataFrame:
    return scores.withColumnRenamed("value", "y").join(features.select("split", "series_id", "feature", F.col("value").alias("x")), ["split", "series_id"])


def assoc_features_vs_fc_eval(fc_eval: DataFrame, features: DataFrame) -> DataFrame:
    """Every metric against every feature, plain and partial."""
    rows = _joined(fc_eval, features)
    one = as_assoc(spearman(rows, ["split", "metric", "feature"]), "fc_eval_vs_features", "spearman")
    two = as_assoc(partial_spearman(rows, ["split", "metric"]), "fc_eval_vs_features", "partial_spearman")
    return one.unionByName(two)


def assoc_pred_eval_vs_features(evals: DataFrame, features: DataFrame) -> DataFrame:
    rows = _joined(evals, features)
    keys = ["split", "predictor", "pred_metric", "metric"]
    one = as_assoc(spearman(rows, [*keys, "feature"]), "pred_eval_vs_features", "spearman")
    two = as_assoc(partial_spearman(rows, keys), "pred_eval_vs_features", "partial_spearman")
    return one.unionByName(two)


def assoc_pred_eval_vs_fc_eval(evals: DataFrame, fc_eval: DataFrame) -> DataFrame:
    """Predictor error against realised accuracy; the union of keys is formed, pairs must be complete."""
    predictors = evals.select("split", "predictor", "pred_metric", "metric").distinct()
    actual = fc_eval.select("split", "series_id", "metric", F.col("value").alias("y")).join(predictors, ["split", "metric"])
    rows = evals.select("split", "series_id", "predictor", "pred_metric", "metric", F.col("value").alias("x")).join(
        actual, ["split", "series_id", "predictor", "pred_metric", "metric"], "full_outer"
    )
    return as_assoc(spearman(rows, ["split", "predictor", "pred_metric", "metric"]), "pred_eval_vs_fc_eval", "spearman")


AGG = {"metric": "__agg_fc__", "predictor": "__agg_pred__", "both": "__agg_fc_pred__"}


def averaged(evals: DataFrame, fc_eval: DataFrame) -> DataFrame:
    """Predictor errors and scores averaged over metrics, over predictors, over both, and as they are."""
    rows = evals.select("split", "series_id", "pred_metric", "predictor", "metric", F.col("value").alias("x")).join(
        fc_eval.select("split", "series_id", "metric", F.col("value").alias("y")), ["split", "series_id", "metric"]
    )
    g = rows.groupingSets(
        [["split", "series_id", "pred_metric", "predictor", "metric"], ["split", "series_id", "pred_metric", "predictor"], ["split", "series_id", "pred_metric", "metric"], ["split", "series_id", "pred_metric"]],
        "split", "series_id", "pred_metric", "predictor", "metric",
    ).agg(F.bround(F.avg("x"), 12).alias("x"), F.bround(F.avg("y"), 12).alias("y"), F.grouping("predictor").alias("gp"), F.grouping("metric").alias("gm"))
    both = (F.col("gp") == 1) & (F.col("gm") == 1)
    return g.select(
        "split", "series_id", "pred_metric", "x", "y",
        F.when(both, AGG["both"]).when(F.col("gp") == 1, AGG["predictor"]).otherwise(F.col("predictor")).alias("predictor"),
        F.when(both, AGG["both"]).when(F.col("gm") == 1, AGG["metric"]).otherwise(F.col("metric")).alias("metric"),
    )


def assoc_grouping_sets(evals: DataFrame, fc_eval: DataFrame) -> DataFrame:
    return as_assoc(spearman(averaged(evals, fc_eval), ["split", "predictor", "pred_metric", "metric"]), "pred_eval_vs_fc_eval_averaged", "spearman")


def mann_whitney(evals: DataFrame) -> DataFrame:
    """Every ordered pair of predictors on the series both have: U, z, effect size, p, medians."""
    e = evals.where(finite("value").isNotNull())
    base = ["split", "pred_metric", "metric"]
    a = e.select(*base, "series_id", F.col("predictor").alias("predictor1"), F.col("value").alias("v1"))
    b = e.select(*base, "series_id", F.col("predictor").alias("predictor2"), F.col("value").alias("v2"))
    pairs = a.join(b, [*base, "series_id"]).where("predictor1 <> predictor2")
    keys = [*base, "predictor1", "predictor2"]
    both = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("g"), F.col("v1").alias("v")), F.struct(F.lit(2).alias("g"), F.col("v2").alias("v")))).alias("s")).select(*keys, "s.g", "s.v")
    ranked = distributed_rank(both, keys, "v", "r")
    first = F.col("g") == 1
    sums = ranked.groupBy(*keys).agg(F.count(F.when(first, 1)).alias("n1"), F.count(F.when(~first, 1)).alias("n2"), F.sum(F.when(first, F.col("r"))).alias("r1"))
    ties = both.groupBy(*keys, "v").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    q = exact_quantiles(both, [*keys, "g"], "v", {"med": 0.5, "q1": 0.25, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    q1 = q.where("g = 1").select(*keys, F.col("med").alias("median1"), F.col("iqr").alias("iqr1"))
    q2 = q.where("g = 2").select(*keys, F.col("med").alias("median2"), F.col("iqr").alias("iqr2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, mu = n1 + n2, n1 * n2 / 2
    g = sums.join(ties, keys).withColumn("u_stat", F.col("r1") - n1 * (n1 + 1) / 2)
    g = g.withColumn("z_value", (F.col("u_stat") - mu) / F.sqrt(n1 * n2 * (n + 1) / 12))
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    gap = F.abs(F.col("u_stat") - mu) - 0.5
    g = g.withColumns({"_gap": gap, "_zc": F.when(sd > 0, gap / sd)})
    p = F.when(F.col("_gap") <= 0, 1.0).when(F.col("_zc").isNotNull(), normal_two_sided("_zc"))  # all values tied: no difference
    g = g.withColumns({"pvalue": p, "effect_r": F.col("z_value") / F.sqrt(n)}).withColumn("better_at_5pct", F.coalesce(F.col("pvalue") <= 0.05, F.lit(False)))
    out = g.join(q1, keys).join(q2, keys)
    return out.select(*keys, "n1", "n2", "median1", "iqr1", "median2", "iqr2", "u_stat", "z_value", "pvalue", "effect_r", "better_at_5pct")


def by_pvalue(table: DataFrame) -> DataFrame:
    """Report order: smallest p first, unknown last."""
    return table.orderBy(F.col("pvalue").asc_nulls_last())
