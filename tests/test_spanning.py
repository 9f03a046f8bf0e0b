"""Least connections against a one-by-one tree, graphs of lines and connectors, lengths outside boxes."""

import math
import random

import pytest

from fieldlark.operators import spanning as S


def tree(links):
    root, keep = {}, set()

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for w, a, b, p, q in sorted((w, min(a, b), max(a, b), p, q) for p, q, a, b, w in links):
        if find(p) != find(q):
            root[find(p)] = find(q)
            keep.add((a, b, w))
    return keep


@pytest.mark.parametrize("settle", [0, 40, 10_000])
def test_forest(spark, settle):
    r = random.Random(4)
    links = [(a := r.randrange(120), b := r.randrange(120), a, b, r.randrange(12)) for _ in range(500)]
    links += [(a := 200 + r.randrange(9), b := 200 + r.randrange(9), a, b, 5) for _ in range(40)] + [(300, 300, 300, 300, 1)] + [(0, k, 0, k, 3) for k in range(400, 460)]
    df = spark.createDataFrame([(a, b, w) for _, _, a, b, w in links], "a long, b long, w int")
    assert {tuple(x) for x in S.least_connections(df, "w", settle=settle).collect()} == tree(links)


@pytest.mark.parametrize("settle", [0, 10_000])
def test_forest_of_groups(spark, settle):
    r = random.Random(5)
    links = [(r.randrange(30), r.randrange(30), 1000 + k, 5000 + r.randrange(99), r.randrange(6)) for k in range(300)]
    df = spark.createDataFrame(links, "p long, q long, a long, b long, w int")
    assert {tuple(x) for x in S.least_connections(df, "w", joins=("p", "q"), settle=settle).collect()} == tree(links)


def test_no_links(spark):
    df = spark.createDataFrame([(1, 1, 2)], "a long, b long, w int")
    assert S.least_connections(df, "w").count() == 0


def test_graph_of_lines(spark):
    rows = [(k, 0.0, 3.0 * k, 50.0) for k in range(1, 6)] + [(9, 500.0, 0.0, 10.0)]
    stops = spark.createDataFrame([(k, at, x + at / 1000, y) for k, x, y, n in rows for at in (0, int(n * 1000))], "line long, at long, x double, y double")
    made = S.plan_connectors(stops, reach=3.5)
    assert sorted(made.collect()) == [(k << 32, (k + 1) << 32, 3000) for k in range(1, 5)]
    extra = made.unionByName(spark.createDataFrame([((1 << 32) + 20_000, (2 << 32) + 25_000, 7)], "a long, b long, length long"))
    graph = S.assemble_graph(spark.createDataFrame([(k, int(n * 1000)) for k, _, _, n in rows], "line long, length long"), extra)
    got = sorted(tuple(r) for r in graph.collect())
    assert len(got) == 6 + 2 + 5
    assert ((1 << 32), (1 << 32) + 20_000, 20_000, "line") in got and ((1 << 32) + 20_000, (1 << 32) + 50_000, 30_000, "line") in got
    assert sum(r[2] for r in got if r[3] == "line") == 260_000


def test_outside(spark):
    r = random.Random(6)
    boxes = [(x := r.uniform(0, 40), y := r.uniform(0, 40), x + r.uniform(1, 9), y + r.uniform(1, 9)) for _ in range(25)]
    segments = [(k, r.uniform(0, 40), r.uniform(0, 40), r.uniform(0, 40), r.uniform(0, 40)) for k in range(40)] + [(90, 3.0, -9.0, 3.0, 60.0), (91, -9.0, 3.0, 60.0, 3.0), (92, 1.0, 1.0, 1.0, 1.0), (93, -9.0, -9.0, -8.0, -8.0)]
    s = spark.createDataFrame(segments, "k long, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double")
    got = {x.k: x for x in S.outside_lengths(s, b, "k").collect()}
    n = 20_000
    for k, x0, y0, x1, y1 in segments:
        out = sum(not any(a <= x0 + (x1 - x0) * t <= c and d <= y0 + (y1 - y0) * t <= e for a, d, c, e in boxes) for t in ((i + 0.5) / n for i in range(0, n, 20)))
        length = math.hypot(x1 - x0, y1 - y0)
        assert got[k].length == pytest.approx(length) and got[k].outside == pytest.approx(length * out / (n / 20), abs=0.25)
    assert got[93].outside == pytest.approx(math.sqrt(2))
    edges = s.select("k").union(spark.range(1000, 1001))
    kept = {x.k for x in S.restrict_outside(edges, s, b, "k", most=10.0).collect()}
    assert kept == {k for k, v in got.items() if v.outside <= 10} | {1000}
