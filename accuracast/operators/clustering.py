"""Clusters of training series in the reduced feature space, their quality, and the choice of k."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accuracast.functions.scale import exact_quantiles
from accuracast.operators.featurespace import as_vectors, knn
from accuracast.session import checkpointed, written

SEED = 42
NOISE = -1
#: Relative width at which the bisection of the neighbourhood radius ends.
PRECISION = 0.05


def cluster_range(n: int, step: int = 1) -> list[int]:
    """Candidate numbers of clusters for n training series."""
    if n < 30:
        return list(range(2, n - 1))
    return list(range(max(2, math.ceil(n / 100)), math.ceil(n / 10), step))


def vectors(points: DataFrame) -> DataFrame:
    """Long points → (id, v array)."""
    return as_vectors(points, ["series_id"]).withColumnRenamed("series_id", "id")


def cluster_kmeans(points: DataFrame, k: int) -> DataFrame:
    """(series_id, label) by k-means."""
    v = vectors(points).select("id", array_to_vector("v").alias("features"))
    model = KMeans(k=k, seed=SEED).fit(v)
    return model.transform(v).select(F.col("id").alias("series_id"), F.col("prediction").alias("label"))


def cluster_hier(points: DataFrame, k: int) -> DataFrame:
    """(series_id, label) by bisecting k-means, the divisive hierarchy Spark offers."""
    v = vectors(points).select("id", array_to_vector("v").alias("features"))
    model = BisectingKMeans(k=k, seed=SEED).fit(v)
    return model.transform(v).select(F.col("id").alias("series_id"), F.col("prediction").alias("label"))


# ---- density clusters ---------------------------------------------------------------------------


def distance(a: Column, b: Column, dims: int) -> Column:
    return F.sqrt(sum(((F.get(a, F.lit(j)) - F.get(b, F.lit(j))) * (F.get(a, F.lit(j)) - F.get(b, F.lit(j))) for j in range(1, dims)),
                      (F.get(a, F.lit(0)) - F.get(b, F.lit(0))) * (F.get(a, F.lit(0)) - F.get(b, F.lit(0)))))


def extended(cells: Column, span: Column) -> Column:
    """Every prefix in ``cells`` followed by every value in ``span``."""
    return F.flatten(F.transform(cells, lambda head: F.transform(span, lambda x: F.concat(head, F.array(x)))))


def neighbour_cells(cell: Column, dims: int) -> Column:
    """All cells that can hold a point within the radius, the own cell included."""
    reach = math.ceil(math.sqrt(dims))
    cells = F.array(F.array().cast("array<bigint>"))
    for j in range(dims):
        span = F.sequence(F.get(cell, F.lit(j)) - reach, F.get(cell, F.lit(j)) + reach)
        cells = extended(cells, span)
    return cells


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): smallest node of each component, by rounds of neighbour minimum and pointer jumping.

    Every round is checkpointed: a lost executor restarts from the round, and the plan stays flat.
    """
    labels = nodes.select("node", F.col("node").alias("comp"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("c"))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = checkpointed(step.join(jump, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("comp"), (F.least("c", F.coalesce("cc", "c")) != F.col("comp")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def cluster_density(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(series_id, label) of DBSCAN, -1 for noise; clusters numbered by their smallest series_id."""
    return density_of(written(vectors(points), "points"), eps, min_samples)


def density_of(v: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """DBSCAN of (id, v array) points.

    Cells have a diagonal of eps, so all points of a cell are neighbours. Copies of a point become
    one weighted point, a cell that holds min_samples points makes all of them core without
    comparing any pair, and cells (not points) are the nodes of the component search.
    """
    dims = v.select(F.size("v")).first()[0]
    side = eps / math.sqrt(dims)
    spots = v.groupBy("v").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("first"))
    spots = spots.withColumn("cell", F.transform("v", lambda x: F.floor(x / side).cast("bigint")))
    spots = written(spots.withColumn("mass", F.sum("w").over(Window.partitionBy("cell"))), "spots")
    sparse = spots.where(F.col("mass") < min_samples)
    near = sparse.select("v", F.explode(neighbour_cells(F.col("cell"), dims)).alias("cell"))
    near = near.join(spots.select("cell", F.col("v").alias("u"), "w"), "cell").where(distance(F.col("v"), F.col("u"), dims) <= eps)
    core_sparse = near.groupBy("v").agg(F.sum("w").alias("k")).where(F.col("k") >= min_samples).select("v")
    core = spots.where(F.col("mass") >= min_samples).unionByName(sparse.join(core_sparse, "v", "left_semi"))
    core = written(core.select("v", "cell", "first"), "core")
    cells = core.groupBy("cell").agg(F.min("first").alias("node"))  # a cell is named by its smallest series
    named = core.join(cells, "cell").select("v", "cell", "node")
    pairs = named.select("v", F.col("node").alias("a"), F.explode(neighbour_cells(F.col("cell"), dims)).alias("cell"))
    pairs = pairs.join(named.select("cell", F.col("v").alias("u"), F.col("node").alias("b")), "cell").where("a <> b")
    edges = written(pairs.where(distance(F.col("v"), F.col("u"), dims) <= eps).select("a", "b").distinct(), "edges")
    comp = connected(edges, cells.select("node"))
    labelled = named.join(comp, "node").select("v", "cell", "comp")
    rest = spots.join(core.select("v"), "v", "left_anti").select("v", F.explode(neighbour_cells(F.col("cell"), dims)).alias("cell"))
    border = rest.join(labelled.select("cell", F.col("v").alias("u"), "comp"), "cell").where(distance(F.col("v"), F.col("u"), dims) <= eps)
    border = border.groupBy("v").agg(F.min("comp").alias("comp"))
    known = labelled.select("v", "comp").unionByName(border)
    names = comp.select("comp").distinct().withColumn("label", (F.row_number().over(Window.orderBy("comp")) - 1).cast("int"))  # one row per cluster
    return v.join(known, "v", "left").join(names, "comp", "left").select(F.col("id").alias("series_id"), F.coalesce("label", F.lit(NOISE)).alias("label"))


def starting_radius(v: DataFrame, min_samples: int) -> float:
    """90 % quantile of the distance to the min_samples-th nearest point, the point itself included."""
    far = knn(v, v, min_samples).groupBy("target_id").agg(F.max("distance").alias("d")).withColumn("_all", F.lit(1))
    return exact_quantiles(far, ["_all"], "d", {"q": 0.9}).first()["q"]


@dataclass(frozen=True)
class DensityFit:
    """Labels at the radius found, the clusters they have, and whether that is the number asked for."""

    labels: DataFrame
    radius: float
    found: int
    converged: bool


class DensitySearch:
    """Radii at which a density clustering of the same points has given numbers of clusters.

    Beyond some radius clusters only merge, so their number falls towards one. The search brackets the
    target on that falling side by doubling and halving, and bisects the logarithm of the radius until
    the number is met or the bracket is narrower than ``precision``. Only counts reach the driver; fits
    are shared between targets.
    """

    def __init__(self, points: DataFrame, n: int, precision: float = PRECISION):
        self.v = written(vectors(points), "points")
        self.min_samples = max(2, min(5, n))
        self.enough = n >= self.min_samples
        self.precision = precision
        self.start = math.log(starting_radius(self.v, self.min_samples) or 1.0)
        self.fits: dict[float, tuple[DataFrame, int]] = {}

    def found(self, at: float) -> int:
        if at not in self.fits:
            labels = written(density_of(self.v, math.exp(at), self.min_samples), "density")
            self.fits[at] = (labels, labels.where(F.col("label") != NOISE).select("label").distinct().count())
        return self.fits[at][1]

    def fit(self, target: int) -> DensityFit:
        stride = math.log(2)
        high = self.start
        # at last all points are one cluster, unless they are too few for any
        while self.enough and (self.found(high) > target or self.found(high) == 0):
            high += stride
        low = min(high, self.start)
        # down to a radius with enough clusters, or one that leaves nothing but noise
        while self.found(low) < target and self.found(low) > 0:
            low -= stride
        # fits for other targets may narrow the bracket
        above = {at for at, (_, k) in self.fits.items() if low <= at < high and (k > target or k == 0)}
        low = max(above, default=low)
        high = min((at for at in self.fits if at > low), default=high)
        while high - low > self.precision and target not in (self.found(low), self.found(high)):
            middle = (low + high) / 2
            if self.found(middle) > target or self.found(middle) == 0:
                low = middle
            else:
                high = middle
        best = min(self.fits, key=lambda at: (abs(self.fits[at][1] - target), self.fits[at][1] < target, at))
        labels, found = self.fits[best]
        return DensityFit(labels, math.exp(best), found, found == target)


# ---- quality and choice -------------------------------------------------------------------------


def cluster_sse(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Within-cluster sum of squares per labelling: (k, sse). ``labels``: k, series_id, label."""
    rows = labels.join(points, "series_id")
    per = rows.groupBy("k", "label", "feature").agg((F.var_pop("value") * F.count("value")).alias("s"))
    return per.groupBy("k").agg(F.sum("s").alias("sse"))


def davies_bouldin(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, db): mean over clusters of the worst ratio of spreads to centroid distance."""
    rows = labels.join(points, "series_id")
    centres = rows.groupBy("k", "label", "feature").agg(F.avg("value").alias("c"))
    spread = rows.join(centres, ["k", "label", "feature"]).groupBy("k", "label", "series_id").agg(F.sqrt(F.sum((F.col("value") - F.col("c")) * (F.col("value") - F.col("c")))).alias("d"))
    spread = spread.groupBy("k", "label").agg(F.avg("d").alias("s"))
    # centroids against centroids: a table of clusters, not of points
    other = centres.select("k", "feature", F.col("label").alias("label2"), F.col("c").alias("c2"))
    gap = centres.join(other, ["k", "feature"]).where("label <> label2").groupBy("k", "label", "label2").agg(F.sqrt(F.sum((F.col("c") - F.col("c2")) * (F.col("c") - F.col("c2")))).alias("m"))
    both = gap.join(spread, ["k", "label"]).join(spread.select("k", F.col("label").alias("label2"), F.col("s").alias("s2")), ["k", "label2"])
    worst = both.groupBy("k", "label").agg(F.max((F.col("s") + F.col("s2")) / F.when(F.col("m") > 0, F.col("m"))).alias("r"))
    return worst.groupBy("k").agg(F.avg("r").alias("db"))


def silhouette(points: DataFrame, labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, silhouette) on squared distances, which need cluster sums only and no pairs of points."""
    v = vectors(points).withColumnRenamed("id", "series_id").select("series_id", array_to_vector("v").alias("features"))
    scores = []
    for k in ks:
        one = labels.where(F.col("k") == k).join(v, "series_id")
        alone = one.select("label").distinct().count() < 2
        scores.append((k, -1.0 if alone else ClusteringEvaluator(predictionCol="label").evaluate(one)))
    return points.sparkSession.createDataFrame(scores, "k int, silhouette double")


def select_best_k(quality: DataFrame) -> DataFrame:
    """One row: elbow, best k by each index, their mean rounded up, and the nearest candidate.

    ``quality``: k, sse, db, silhouette, a row per candidate.
    """
    ends = F.struct(
        F.min("k").alias("x1"), F.min_by("sse", "k").alias("y1"), F.max("k").alias("x2"), F.max_by("sse", "k").alias("y2"),
    )
    e = quality.agg(ends.alias("e")).scalar()
    q = quality.withColumn("e", e)
    dx, dy = F.col("e.x2") - F.col("e.x1"), F.col("e.y2") - F.col("e.y1")
    # a single candidate has no line to be off from
    off = F.coalesce(F.try_divide(F.abs(dx * (F.col("sse") - F.col("e.y1")) - dy * (F.col("k") - F.col("e.x1"))), F.sqrt(dx * dx + dy * dy)), F.lit(0.0))
    q = q.withColumn("off", F.bround(off, 9))
    picks = q.agg(
        F.min_by("k", F.struct(-F.col("off"), F.col("k"))).alias("k_elbow"), F.min_by("k", F.struct("db", "k")).alias("k_db"),
        F.min_by("k", F.struct(-F.col("silhouette"), F.col("k"))).alias("k_sil"), F.collect_list("k").alias("ks"),
    ).withColumn("k_avg", F.ceil((F.col("k_elbow") + F.col("k_db") + F.col("k_sil")) / 3.0).cast("int"))
    best = F.element_at(F.array_sort(F.transform("ks", lambda k: F.struct(F.abs(k - F.col("k_avg")).alias("d"), (-k).alias("nk")))), 1)
    return picks.select("k_elbow", "k_db", "k_sil", "k_avg", (-best["nk"]).alias("best_k"))


def fit_clusters(name: str, points: DataFrame, n: int, counts: Sequence[int] | None = None, precision: float = PRECISION) -> DataFrame:
    """(series_id, label) of the best candidate of a clustering method."""
    ks = list(counts) if counts is not None else cluster_range(n, 2 if name == "cl_density_cv" else 1)
    search = DensitySearch(points, n, precision) if name == "cl_density_cv" else None
    parts = []
    for k in ks:
        if name == "cl_kmeans_cv":
            one = cluster_kmeans(points, k)
        elif name == "cl_hier_cv":
            one = cluster_hier(points, k)
        else:
            one = search.fit(k).labels
        parts.append(one.select(F.lit(k).alias("asked"), "series_id", "label"))
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.unionAll(p)
    labels = written(labels, "labels")
    found = labels.groupBy("asked").agg(F.count_distinct("label").alias("found")).where(F.col("found") >= ks[0])
    usable = {r.asked: r.found for r in found.collect()}  # one row per candidate
    if len(set(usable.values())) < 2:
        pick = min(usable, default=ks[0])
        return labels.where(F.col("asked") == pick).select("series_id", "label")
    # candidates are told apart by the clusters they have; the first with a given number stands for it
    by_found: dict[int, int] = {}
    for asked in sorted(usable):
        by_found.setdefault(usable[asked], asked)
    keep = labels.where(F.col("asked").isin(list(by_found.values())))
    found_of = F.create_map(*[F.lit(x) for k, a in by_found.items() for x in (a, k)])
    keep = keep.select(F.try_element_at(found_of, F.col("asked")).alias("k"), "series_id", "label")
    quality = cluster_sse(points, keep).join(davies_bouldin(points, keep), "k").join(silhouette(points, keep, list(by_found)), "k")
    best = select_best_k(written(quality, "quality")).first()["best_k"]
    return keep.where(F.col("k") == best).select("series_id", "label")


def assign_cluster(points: DataFrame, train_points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Label of the nearest training series."""
    near = knn(vectors(points), vectors(train_points), 1)
    return near.join(clusters.withColumnRenamed("series_id", "train_id"), "train_id").select(F.col("target_id").alias("series_id"), "label")


def cluster_counts(train: DataFrame, target: DataFrame) -> DataFrame:
    """Size per training label and number of targets assigned to it, zeros kept."""
    a = train.groupBy("label").agg(F.count(F.lit(1)).alias("n_train"))
    b = target.groupBy("label").agg(F.count(F.lit(1)).alias("n_target"))
    return a.join(b, "label", "left").withColumn("n_target", F.coalesce("n_target", F.lit(0)))


def octant_representatives(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Series nearest the centre of each octant of the box around three axes; bounds belong to both sides."""
    wide = points.where(F.col("feature").isin(*axes)).groupBy("series_id").pivot("feature", list(axes)).agg(F.first("value")).dropna()
    box = wide.agg(*[F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")).alias(a) for a in axes])
    bounds = box.select(F.struct(*axes)).scalar()
    rows = wide.withColumn("_b", bounds)
    cells = []
    for bits in itertools.product([0, 1], repeat=3):
        inside, dist = F.lit(True), F.lit(0.0)
        for a, bit in zip(axes, bits):
            lo, hi = F.col(f"_b.{a}.lo"), F.col(f"_b.{a}.hi")
            mid = 0.5 * (lo + hi)
            low, high = (lo, mid) if bit == 0 else (mid, hi)
            inside = inside & (F.col(a) >= low) & (F.col(a) <= high)
            dist = dist + (F.col(a) - 0.5 * (low + high)) * (F.col(a) - 0.5 * (low + high))
        cells.append(F.struct(F.lit("-".join(map(str, bits))).alias("octant"), inside.alias("inside"), F.sqrt(dist).alias("distance")))
    rows = rows.select("series_id", F.explode(F.array(*cells)).alias("o")).where("o.inside")
    best = rows.groupBy(F.col("o.octant").alias("octant")).agg(F.min(F.struct(F.col("o.distance").alias("distance"), "series_id")).alias("b"))
    return best.select("octant", "b.series_id", "b.distance")
