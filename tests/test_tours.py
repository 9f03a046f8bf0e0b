"""Tours over points against those over all distances."""

import tracemalloc

import numpy as np
import pytest

from fieldlark.operators import graph as G
from fieldlark.operators import tours as T

POINTS = {
    "spread": lambda r, n: r.uniform(0, 100, (n, 2)),
    "ties": lambda r, n: r.integers(0, 7, (n, 2)).astype(float),
    "lines": lambda r, n: np.stack((r.integers(0, 97, n).astype(float), np.round(r.uniform(-10, 100, n), 4)), 1),
    "one line": lambda r, n: np.stack((np.zeros(n), r.integers(0, 50, n) / 7), 1),
    "one place": lambda r, n: np.zeros((n, 2)),
}


@pytest.mark.parametrize("kind", POINTS)
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12, 60, 250])
def test_same_tours_as_over_all_distances(kind, n):
    """F13"""
    for seed in range(3):
        xy = POINTS[kind](np.random.default_rng(seed), n)
        d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
        first = G.nearest_neighbour_tour(d)
        assert T.nearest_neighbour_tour(xy) == first
        assert T.improve_tour(xy, first, 5) == G.improve_tour(d, first, 5)


def test_memory_of_a_tour_follows_its_points(spark):
    """1,500 stops have 18 MB of distances."""
    from fieldlark.plans import structural

    supplier = spark.range(1500).selectExpr("id AS s_suppkey", "5L AS s_nationkey", "id * 7919 % 1009 / 7D AS s_acctbal")
    seen = []

    class Groups:  # the query's own function, run here
        def groupBy(self, *_):
            return self

        repartition = groupBy

        def applyInPandas(self, run, _):
            tracemalloc.start()
            seen.append((run(frame), tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()

    frame = supplier.selectExpr("s_nationkey % 5 AS block", "s_suppkey", "cast(s_suppkey % 97 AS double) AS x", "s_acctbal / 100 AS y").toPandas()
    structural.best_tour(type("Tables", (), {"supplier": type("Rows", (), {"select": lambda self, *c: Groups()})()})())
    (tour, peak), = seen
    assert sorted(tour["s_suppkey"]) == list(range(1500)) and list(tour["seq"]) == list(range(1500))
    assert peak < 5_000_000


def test_a_task_a_block(spark, sf_dir):
    """the engine puts partitions of few bytes together."""
    from fieldlark.plans import catalog

    per = catalog.QUERIES["best_tour"](spark, sf_dir).selectExpr("block", "spark_partition_id() AS task").distinct().collect()
    assert len({r.task for r in per}) == len({r.block for r in per}) == len(per) > 1
