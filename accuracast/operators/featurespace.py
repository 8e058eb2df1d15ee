"""Preparing the feature space: cuts, imputation, scaling, reduction, nearest series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accuracast.functions.columns import finite, varies
from accuracast.functions.scale import exact_quantiles
from accuracast.operators import neighbours
from accuracast.session import written

MAX_NULL_SHARE = 0.10
COMPONENTS = 3
TINY = 1e-12
# How far above the median jump an elbow must be.
SENSITIVITY = {"low": 3.0, "medium": 4.0, "strong": 6.0}
#: Targets that search one box of points in one group.
BLOCK_ROWS = 20000


def medians(features: DataFrame) -> DataFrame:
    """(feature, median, n) over all series, whatever their number."""
    return exact_quantiles(features, ["feature"], "value", {"median": 0.5})


def feature_nan_cut(features: DataFrame, cut: float = MAX_NULL_SHARE) -> DataFrame:
    """Drop features missing in more than ``cut`` of the series, fill the rest with the median."""
    f = features.withColumn("value", finite("value"))
    share = f.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("gap")).where(F.col("gap") <= cut)
    kept = f.join(share.select("feature"), "feature").join(medians(f).select("feature", "median"), "feature", "left")
    return kept.withColumn("value", F.coalesce("value", "median")).select(*features.columns)


def apply_norm_features(features: DataFrame) -> DataFrame:
    """Finite values only; gaps become the feature median, 0 when there is none."""
    f = features.withColumn("value", finite("value"))
    filled = f.join(medians(f).select("feature", "median"), "feature", "left")
    return filled.withColumn("value", F.coalesce("value", "median", F.lit(0.0))).select(*features.columns)


def zscore_stats(features: DataFrame) -> DataFrame:
    """(feature, mu, sigma) of a training set; a constant feature has sigma 1."""
    sigma = F.when(varies("value"), F.stddev_pop("value")).otherwise(1.0)
    return features.groupBy("feature").agg(F.avg("value").alias("mu"), sigma.alias("sigma"))


def zscore_features(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(value - mu) / sigma with training statistics; missing values sit at the centre."""
    z = features.join(stats, "feature")
    return z.withColumn("value", F.coalesce((F.col("value") - F.col("mu")) / F.col("sigma"), F.lit(0.0))).select(*features.columns)


def minmax_stats(features: DataFrame) -> DataFrame:
    return features.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def minmax_scale(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Train minimum → 0, train maximum → 1. Other data may leave the unit box."""
    span = F.col("hi") - F.col("lo")
    z = features.join(stats, "feature")
    return z.withColumn("value", (F.col("value") - F.col("lo")) / F.when(span > 0, span).otherwise(1.0)).select(*features.columns)


def robust_stats(features: DataFrame) -> DataFrame:
    q = exact_quantiles(features, ["feature"], "value", {"q1": 0.25, "centre": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("feature", "centre", F.when(iqr > 0, iqr).otherwise(1.0).alias("iqr"))


def as_vectors(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One array per series, features in name order."""
    return features.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("v"))


class FeatureSpace:
    """Training-set transformation: z-score, median fill, robust scale, three components, unit box.

    The state is one row per feature plus the component matrix (features x 3), so it is small
    whatever the number of series.
    """

    def __init__(self, train: DataFrame, keys: Sequence[str]):
        self.keys = list(keys)
        raw = written(feature_nan_cut(train), "features")  # read by every step below
        self.z = written(zscore_stats(raw), "scale")
        scaled = self._scaled(raw, robust=False)
        self.robust = written(robust_stats(scaled), "scale")
        self.features = [r.feature for r in self.z.select("feature").orderBy("feature").collect()]
        vectors = as_vectors(self._scaled(raw), self.keys).select(*self.keys, array_to_vector("v").alias("v"))
        k = min(COMPONENTS, len(self.features))
        self.pca = PCA(k=k, inputCol="v", outputCol="pc").fit(vectors)
        self.box = written(minmax_stats(self._reduced(raw)), "box")

    def _scaled(self, features: DataFrame, robust: bool = True) -> DataFrame:
        z = zscore_features(features, self.z)
        if not robust:
            return z
        r = z.join(self.robust, "feature")
        return r.withColumn("value", (F.col("value") - F.col("centre")) / F.col("iqr")).select(*z.columns)

    def _aligned(self, features: DataFrame) -> DataFrame:
        """Exactly the training features for every series; absent ones are missing values."""
        ids = features.select(*self.keys).distinct().withColumn("feature", F.explode(F.array(*[F.lit(x) for x in self.features])))
        return ids.join(features.select(*self.keys, "feature", "value"), [*self.keys, "feature"], "left")

    def _reduced(self, features: DataFrame) -> DataFrame:
        v = as_vectors(self._scaled(self._aligned(features)), self.keys).select(*self.keys, array_to_vector("v").alias("v"))
        pc = self.pca.transform(v).select(*self.keys, F.posexplode(vector_to_array("pc")).alias("_i", "value"))
        return pc.select(*self.keys, F.concat(F.lit("pc"), (F.col("_i") + 1).cast("string")).alias("feature"), "value")

    def reduce(self, features: DataFrame) -> DataFrame:
        return self._reduced(features)

    def transform(self, features: DataFrame) -> DataFrame:
        """Points of any series in the training box, long form."""
        return minmax_scale(self._reduced(features), self.box)


# ---- nearest series -----------------------------------------------------------------------------


def knn(targets: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """Exact k nearest training points of every target, see ``neighbours``: target_id, train_id, rank, distance."""
    return neighbours.knn(targets, train, k, BLOCK_ROWS)


def slope_cut(neighbors: DataFrame, k: int, min_k: int = 5, sensitivity: str = "medium") -> DataFrame:
    """Cut each neighbour list at the first jump in distance that stands out (lists hold at most k rows)."""
    w = Window.partitionBy("target_id")
    nxt = F.lead("distance").over(w.orderBy("rank"))
    n = neighbors.select("*", ((nxt - F.col("distance")) / F.greatest("distance", F.lit(TINY))).alias("jump"), F.count(F.lit(1)).over(w).alias("m"))
    n = n.withColumn("med", F.median("jump").over(w)).withColumn("mad", F.median(F.abs(F.col("jump") - F.col("med"))).over(w) + TINY)
    elbow = F.min(F.when(F.col("jump") > F.col("med") + SENSITIVITY[sensitivity] * F.col("mad"), F.col("rank"))).over(w)
    used = F.greatest(F.lit(min(min_k, k)), F.least(F.coalesce(elbow, F.col("m")), F.col("m")))
    return n.withColumn("k_used", used).where(F.col("rank") <= F.col("k_used")).select("target_id", "train_id", "rank", "distance")


def nearest_series(train: DataFrame, targets: DataFrame, k: int = 30, min_k: int = 5, cut: bool = True, sensitivity: str = "medium") -> DataFrame:
    """Nearest training series by standardised Euclidean distance; inputs are long features by series_id."""
    means = train.groupBy("feature").agg(F.avg(finite("value")).alias("m")).where(F.col("m").isNotNull())
    listed = means.agg(F.collect_list(F.struct("feature", "m"))).scalar()  # one entry per feature

    def filled(f: DataFrame) -> DataFrame:
        grid = f.select("series_id").distinct().select("series_id", F.explode(listed).alias("_m")).select("series_id", "_m.feature", "_m.m")
        got = grid.join(f.select("series_id", "feature", finite("value").alias("value")), ["series_id", "feature"], "left")
        return got.select("series_id", "feature", F.coalesce("value", "m").alias("value"))

    t = filled(train)
    stats = zscore_stats(t)
    points = lambda f: as_vectors(zscore_features(f, stats), ["series_id"]).withColumnRenamed("series_id", "id")
    near = knn(points(filled(targets)), points(t), k)
    return slope_cut(near, k, min_k, sensitivity) if cut else near
