"""Joins by adaptive cells against joins by a grid, over boxes a third of which lie in one small place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.operators.quadtree import adaptive_box_join, quadtree
from fieldlark.operators.spatial import box_join

COLS = ("k", "g", "x0", "y0", "x1", "y1")


def boxes(seed, n):
    r = np.random.default_rng(seed)
    third = n // 3
    x = np.concatenate((r.uniform(-500, 500, n - third), r.uniform(77, 77.5, third)))
    y = np.concatenate((r.uniform(-500, 500, n - third), r.uniform(-3, -2.6, third)))
    w = np.where(np.arange(n) < n - third, r.uniform(0, 12, n), r.uniform(0, 0.02, n))
    w[:3], x[:3], y[:3] = 900, -450, -450  # over most of the plane
    w[3:9] = 0
    x[4:9], y[4:9] = 64.0, 128.0  # on corners of cells
    return [(i, i % 3, float(a), float(b), float(a + c), float(b + c / 2)) for i, (a, b, c) in enumerate(zip(x, y, w))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, g int, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize("grow, keys, most", [(0.0, (), 40), (1.5, ("g",), 25), (0.0, ("g",), 2_000)])
def test_same_pairs_as_a_grid(spark, grow, keys, most):
    a, b = frame(spark, boxes(1, 1200) + [(-1, 0, None, 1.0, 2.0, 3.0)]), frame(spark, boxes(2, 900))
    got = adaptive_box_join(a, b, keys=keys, grow=grow, most=most).select("l_k", "r_k").collect()
    want = box_join(a, b, cell=5.0, keys=keys, grow=grow).select("l_k", "r_k").collect()
    assert len(got) == len(set(got)) and set(got) == set(want) and got
    assert set(box_join(a, b, keys=keys, grow=grow).select("l_k", "r_k").collect()) == set(want)


def test_leaves_hold_alike_many(spark):
    df = frame(spark, [r for r in boxes(3, 30_000) if r[4] - r[2] < 100])
    tree = quadtree(df, most=500)
    dealt = df.select(F.explode(tree.cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("cell"))
    per = np.array([r["count"] for r in dealt.groupBy("cell").count().collect()])
    assert per.max() < 4 * 500  # a grid of as many cells has a third of all rows in one
    tasks = [r["count"] for r in dealt.repartition(16, "cell").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 16 and max(tasks) < 4 * np.median(tasks)
    depth = tree.split >> 56
    assert len(set(depth)) > 4


def test_empty_and_single(spark):
    none = frame(spark, [])
    one = frame(spark, [(1, 0, 3.0, 3.0, 3.0, 3.0)])
    assert adaptive_box_join(none, none).count() == adaptive_box_join(one, none).count() == 0
    assert adaptive_box_join(one, one, most=1).count() == 1
    same = frame(spark, [(i, 0, 3.0, 3.0, 4.0, 4.0) for i in range(30)])
    assert adaptive_box_join(same, same, most=5).count() == 900


def test_leaf_bound(spark):
    df = frame(spark, boxes(5, 6_000))
    assert 3 * len(quadtree(df, most=1, most_cells=256).split) + 1 <= 256
