"""Unions, closings, rings and walkable places of boxes against unit cells painted one by one."""

import random
from collections import Counter

import numpy as np
import pytest

from fieldlark.operators import outlines as O

TURN = {O.EAST: (1, 0), O.NORTH: (0, 1), O.WEST: (-1, 0), O.SOUTH: (0, -1)}


def painted(boxes, minus=()):
    cells = {(x, y) for x0, y0, x1, y1 in boxes for x in range(x0, x1) for y in range(y0, y1)}
    return cells - {(x, y) for x0, y0, x1, y1 in minus for x in range(x0, x1) for y in range(y0, y1)}


def rings_of(cells):
    """{(signed area, length, corners from the least)}: unit edges followed, to the left where four meet."""
    out = {}
    for x, y in cells:
        for way, (dx, dy), start in ((O.EAST, (0, -1), (x, y)), (O.NORTH, (1, 0), (x + 1, y)), (O.WEST, (0, 1), (x + 1, y + 1)), (O.SOUTH, (-1, 0), (x, y + 1))):
            if (x + dx, y + dy) not in cells:
                out[start, way] = None
    left, rings = set(out), []
    while left:
        at = first = min(left)
        ring, area, n = [], 0, 0
        before = None
        while True:
            left.discard(at)
            (x, y), way = at
            if before is not None and before != way:
                ring.append((x, y))
            dx, dy = TURN[way]
            area += x * dy
            n += 1
            end = (x + dx, y + dy)
            before, at = way, next((end, w) for w in ((way + 1) % 4, way, (way + 3) % 4) if (end, w) in out)
            if at == first:
                if before != first[1]:
                    ring.append(first[0])
                break
        k = ring.index(min(ring))
        rings.append((area, n, tuple(ring[k:] + ring[:k])))
    return Counter(rings)


def eroded(cells, by):
    return {(x, y) for x, y in cells if all((x + i, y + j) in cells for i in range(-by, by + 1) for j in range(-by, by + 1))}


def closed(boxes, by):
    return eroded(painted([(a - by, b - by, c + by, d + by) for a, b, c, d in boxes]), by)


def some(seed, n, size, wide=9):
    r = random.Random(seed)
    out = [(x := r.randrange(-size, size), y := r.randrange(-size, size), x + r.randrange(0, wide), y + r.randrange(0, wide)) for _ in range(n)]
    return out + [(0, 0, 1, 1), (1, 1, 2, 2), (2, 0, 3, 1), (-size, 5, size, 6)]  # touching corners, one long


def frame(spark, groups):
    rows = [(g, *map(float, b)) for g, boxes in groups.items() for b in boxes]
    return spark.createDataFrame(rows, "g string, x0 double, y0 double, x1 double, y1 double").repartition(3)


def least_first(corners):
    c = [(int(p.x), int(p.y)) for p in corners]
    k = c.index(min(c))
    return tuple(c[k:] + c[:k])


@pytest.mark.parametrize("strip", [1 << 22, 40])
def test_leaf_edges_in_strips(monkeypatch, strip):
    monkeypatch.setattr(O, "STRIP", strip)
    boxes = np.array(some(1, 60, 15), float)
    boxes = boxes[(boxes[:, 0] < boxes[:, 2]) & (boxes[:, 1] < boxes[:, 3])]
    sign = np.where(np.arange(len(boxes)) % 5 == 0, -1, 1)
    e = O.leaf_edges((-64.0, -64.0, 64.0, 64.0), boxes, sign)
    cells = painted([tuple(map(int, b)) for b in boxes[sign == 1]], [tuple(map(int, b)) for b in boxes[sign == -1]])
    assert (e[:, 1] * (e[:, 4] - e[:, 2])).sum() == len(cells)
    assert np.abs(e[:, 3:] - e[:, 1:3]).sum() == sum(r[1] * n for r, n in rings_of(cells).items())


@pytest.mark.parametrize("most", [4, 500])
def test_rings(spark, most):
    groups = {"a": some(2, 70, 20), "b": some(3, 25, 12), "c": [(0, 0, 0, 5), (3, 3, 3, 3)], "d": [(-4, -4, 4, 4)] * 3}
    minus = {"a": some(4, 25, 20, 4)[:-1], "d": [(-1, -1, 1, 1), (1, 1, 2, 2)], "e": [(0, 0, 9, 9)]}
    edges = O.boundary(frame(spark, groups), "g", minus=frame(spark, minus), most=most)
    rings = O.trace(edges, "g").collect()
    for g in "abcd":
        want = rings_of(painted(groups[g], minus.get(g, ())))
        assert Counter((int(r.area), int(r.length), least_first(r.corners)) for r in rings if r.g == g) == want
    assert {r.g for r in rings} == {"a", "b", "d"}
    sizes = {r.g: (r.area, r.length) for r in O.measures(edges, "g").collect()}
    assert sizes["d"] == (59, 32 + 12)


def test_closing_and_lone_lines(spark):
    groups = {"a": some(5, 40, 25, 5), "b": [(0, 0, 30, 0), (5, 4, 25, 4)], "c": [(0, 0, 40, 0)]}
    edges = O.outline_of(frame(spark, groups), "g", reach=2.0, lone_reach=1.0)
    got = {r.g: int(r.area) for r in O.measures(edges, "g").collect()}
    assert got == {"a": len(closed(groups["a"], 2)), "b": len(closed(groups["b"], 2)), "c": 42 * 2}
    assert got["b"] == 20 * 4


def test_walkable(spark):
    ground, barred = {"a": some(6, 50, 20, 6)}, {"a": some(7, 12, 20, 3)[:-1]}
    edges = O.walkable(frame(spark, ground), frame(spark, barred), "g", reach=1.0, margins=(1.0,))
    cells = closed(ground["a"], 1) - painted(barred["a"])
    for margin, want in ((0.0, cells), (1.0, eroded(cells, 1))):
        assert int(O.measures(edges.where(edges.margin == margin), "g").first().area) == len(want)


def test_empty(spark):
    none = frame(spark, {})
    assert O.trace(O.boundary(none, "g"), "g").count() == O.measures(O.boundary(none, "g"), "g").count() == 0


def test_derive(spark):
    from fieldlark.operators.derive import derive

    groups = {"a": some(8, 30, 12, 6), "b": [(40, 0, 44, 3), (60, 0, 61, 1)], "c": []}
    lanes = {"a": some(9, 10, 12, 6), "b": [(45, 0, 47, 3)], " ": [(0, 0, 90, 90)]}
    lines = {"a": [(-12, 0, 12, 0)], "c": [(0, 0, 0, 30)]}
    layer = lambda g: frame(spark, g).selectExpr("g", "cast(x0 as int) % 3 AS tile", "x0", "y0", "x1", "y1")
    rows = spark.createDataFrame([("a", 0.0), ("a", 2.5), ("a", 5.5)], "g string, position double")
    got = {r.g: r for r in derive(layer(groups), layer(lines), layer(lanes), rows, "g", "tile", reach=1.0, lone_reach=2.0).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in "ab":
        every = groups[g] + lanes[g] + lines.get(g, [])
        rings = rings_of(closed(every, 1))
        assert (got[g].canopy_area, got[g].interrow_area, got[g].outline_area) == (len(painted(groups[g])), len(painted(lanes[g])), len(closed(every, 1)))
        assert (got[g].n_parts, got[g].n_holes) == (sum(n for r, n in rings.items() if r[0] > 0), sum(n for r, n in rings.items() if r[0] < 0))
        assert got[g].n_canopies == len(groups[g]) and got[g].outline_length == sum(r[1] * n for r, n in rings.items())
    assert got["a"].n_rows == 3 and got["a"].spacing_med == 2.75 and got["a"].row_length == 24
    assert (got["c"].outline_area, got["c"].canopy_area, got["c"].row_length, got["c"].n_parts) == (4 * 34, 0, 30, 1)
