"""Paths, closed walks, tours around trees and plans against one-by-one versions."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import routes as R


def graph(seed, n, m):
    r = random.Random(seed)
    edges = [(k, k + 1, r.randrange(1, 9)) for k in range(n - 1)] + [(r.randrange(n), r.randrange(n), r.randrange(1, 30)) for _ in range(m)]
    return edges + [(900, 901, 1)]


def distances(edges, source):
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    dist, heap = {}, [(0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for v, w in near[u]:
                heapq.heappush(heap, (d + w, v))
    return dist


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, w long")


def test_ring_positions(spark):
    r = random.Random(1)
    rings, links, at = [], [], 0
    for n in (1, 2, 3, 64, 65, 300):
        items = list(range(at, at + n))
        at += n
        r.shuffle(items)
        rings.append(items)
        links += list(zip(items, items[1:] + items[:1]))
    got = {x.item: (x.ring, x.ahead) for x in R.ring_positions(spark.createDataFrame(links, "item long, next long")).collect()}
    for items in rings:
        k = items.index(min(items))
        for i, item in enumerate(items):
            assert got[item] == (min(items), (k - i) % len(items))


def test_shortest_paths(spark):
    edges = graph(2, 80, 60)
    legs = [(1, 0, 79), (2, 40, 3), (3, 7, 7), (4, 0, 901), (5, 0, 12345), (6, 900, 901), (7, 0, 33)]
    got = defaultdict(list)
    for r in R.shortest_paths(frame(spark, edges), spark.createDataFrame(legs, "leg long, a long, b long"), "w").collect():
        got[r.leg].append((r.step, r.node, r.dist))
    known = {frozenset((a, b)): 0 for a, b, _ in edges}
    for a, b, w in edges:
        known[frozenset((a, b))] = min(known[frozenset((a, b))] or w, w)
    assert set(got) == {1, 2, 3, 6, 7}
    for leg, a, b in legs:
        if leg in got:
            path, dist = sorted(got[leg]), distances(edges, a)
            assert [s for s, _, _ in path] == list(range(len(path))) and path[0][1:] == (a, 0) and path[-1][1:] == (b, dist[b])
            for (_, u, d), (_, v, e) in zip(path, path[1:]):
                assert e - d == known[frozenset((u, v))] and e == dist[v]


def test_unroll(spark):
    edges = graph(3, 60, 30)
    stops = [("x", k, n) for k, n in enumerate([5, 50, 20, 59])] + [("y", 0, 1), ("y", 1, 1), ("y", 2, 30)] + [("z", 0, 3), ("z", 1, 901)]
    rows = R.unroll(frame(spark, edges), spark.createDataFrame(stops, "tour string, at int, node long"), "w").collect()
    assert {r.tour for r in rows} == {"x", "y"}
    for tour in "xy":
        walk = sorted((r.place, r.node, r.along, r.stops or []) for r in rows if r.tour == tour)
        nodes = [n for t, _, n in stops if t == tour]
        legs = list(zip(nodes, nodes[1:] + nodes[:1]))
        assert [p for p, *_ in walk] == list(range(len(walk)))
        assert walk[0][1] == walk[-1][1] == nodes[0] and walk[-1][2] == sum(distances(edges, a)[b] for a, b in legs)
        assert [(k, n) for _, n, _, s in walk for k in s] == list(enumerate(nodes))
        assert all(u[2] <= v[2] for u, v in zip(walk, walk[1:]))


def test_zero_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        R.shortest_paths(frame(spark, [(1, 2, 0)]), spark.createDataFrame([(1, 1, 2)], "leg long, a long, b long"), "w")


def test_tree_tour(spark):
    r = random.Random(4)
    tree = [(r.randrange(k), k) for k in range(1, 70)]
    near = defaultdict(list)
    for a, b in tree:
        near[a].append(b)
        near[b].append(a)
    got = [x.node for x in R.tree_tour(spark.createDataFrame(tree, "a long, b long"), F.lit(9).cast("long")).orderBy("visit").collect()]
    # after (u, v) comes v's next neighbour after u in rising order, around
    seen = [9]
    edges = [(a, b) for a in near for b in near[a]]
    u, v = 9, min(near[9])
    for _ in range(len(edges)):
        if v not in seen:
            seen.append(v)
        ring = sorted(near[v])
        u, v = v, ring[(ring.index(u) + 1) % len(ring)]
    assert got == seen and len(got) == 70


def test_plan(spark):
    edges = graph(5, 50, 50)
    stops = [0, 7, 23, 31, 44, 49]
    df = frame(spark, edges)
    s = spark.createDataFrame([(n,) for n in stops], "node long")
    plan = sorted(tuple(r) for r in R.plan_tour(df, s, "w", 0).collect())
    assert [p[0] for p in plan] == list(range(6)) and plan[0][1] == 0 and plan[-1][2] == 0
    assert sorted(p[1] for p in plan) == stops and all(d == distances(edges, a)[b] for _, a, b, d in plan)
    assert all(p[2] == q[1] for p, q in zip(plan, plan[1:]))
    total = sum(p[3] for p in plan)
    best = R.plan_route(df, s, "w", 0, {"light": F.col("w") < 9, "all": F.lit(True), "none": F.lit(False)}).collect()
    got = {r.policy: r for r in best}
    assert got["all"].n_stops == 6 and got["all"].length == total and [r.policy for r in best if r.chosen] == [min(("light", "all"), key=lambda p: (-got[p].n_stops, got[p].length))]
    assert got["none"].n_stops == 0
