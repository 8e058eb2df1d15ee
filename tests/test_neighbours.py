"""Box search of nearest points against all distances, and how its work grows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accuracast.operators import neighbours as nb


def points(spark, x, prefix="s"):
    return spark.createDataFrame(pd.DataFrame({"id": [f"{prefix}{i:06d}" for i in range(len(x))], "v": np.asarray(x).tolist()}), "id string, v array<double>")


def brute(x, y, k):
    ids = np.array([f"s{i:06d}" for i in range(len(y))])
    out = {}
    for i, p in enumerate(x):
        d = np.sqrt(sum((p[j] - y[:, j]) ** 2 for j in range(y.shape[1])))
        order = np.lexsort((ids, d))[:k]
        out[i] = (ids[order].tolist(), d[order].tolist())
    return out


@pytest.mark.parametrize("dims,k,decimals", [(3, 5, 1), (2, 60, 2), (9, 7, 8)])
def test_lists_equal_all_distances(spark, dims, k, decimals):
    rng = np.random.default_rng(dims)
    y = np.concatenate([rng.normal(c, 0.3, size=(300, dims)) for c in (0, 4, 9)]).round(decimals)
    y[:300] = y[0]  # a third of the points are copies of one
    x = np.concatenate([rng.normal(4, 4, size=(80, dims)).round(decimals), y[:40], np.full((1, dims), 1e6)])
    got = nb.knn(points(spark, x, "t"), points(spark, y), k, block_rows=50, box_rows=32).orderBy("target_id", "rank").toPandas()
    want = brute(x, y, k)
    lists = dict(list(got.groupby("target_id")))
    assert len(lists) == len(x)
    for i in range(len(x)):
        g = lists[f"t{i:06d}"]
        assert (g["train_id"].tolist(), g["distance"].tolist()) == want[i] and g["rank"].tolist() == list(range(1, k + 1))


def test_fewer_points_than_asked_for_and_odd_points(spark):
    y = np.arange(40.0).reshape(20, 2)
    train = points(spark, y).unionByName(spark.createDataFrame([("n", None), ("o", [float("nan"), 1.0]), ("p", [1.0, float("inf")])], "id string, v array<double>"))
    got = nb.knn(train, train, 50, block_rows=7, box_rows=4)
    assert got.groupBy("target_id").count().where("count = 20").count() == 20 and got.count() == 400
    empty = train.where("false")
    assert nb.knn(train, empty, 3, 10).count() == 0 and nb.knn(empty, train, 3, 10, box_rows=4).count() == 0


def test_pairs_grow_slower_than_all_pairs(spark):
    rng = np.random.default_rng(3)
    pairs = {}
    for n in (4000, 40000):
        p = points(spark, rng.normal(size=(n, 3)))
        found = nb.BoxSearch(p, p, 5, block_rows=20000, box_rows=256)
        size = F.create_map(*[F.lit(int(v)) for i, m in enumerate(found.boxes.n) for v in (i, m)])
        pairs[n] = found.homes.agg(F.sum(size[F.col("box")] + F.aggregate("others", F.lit(0), lambda s, b: s + size[b]))).first()[0]
    assert np.log10(pairs[40000] / pairs[4000]) < 1.3, pairs
    assert pairs[40000] < 0.05 * 40000**2
