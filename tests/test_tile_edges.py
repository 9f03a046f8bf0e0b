"""Pairs across the edges of tiles and their numbers against a version that goes one by one."""

import random

from fieldlark.operators import tile_edges as E

SIDE, TOL, LEAST = 40.0, 1.5, 0.5


def one_by_one(boxes):
    order = sorted(boxes, key=lambda b: (b[1], b[2], b[4], b[3], b[5], b[6], b[0]))
    links = []
    for i, (_, r, c, x0, y0, x1, y1) in enumerate(order):
        for j, (_, s, d, u0, v0, u1, v1) in enumerate(order):
            if (s, d) == (r, c + 1) and x1 >= SIDE - TOL and u0 <= TOL:
                share = (min(y1, v1) - max(y0, v0)) / min(y1 - y0, v1 - v0)
            elif (s, d) == (r + 1, c) and y1 >= SIDE - TOL and v0 <= TOL:
                share = (min(x1, u1) - max(x0, u0)) / min(x1 - x0, u1 - u0)
            else:
                continue
            if share >= LEAST:
                links.append((-share, i, j))
    partner, names, k = {}, {}, 0
    for _, i, j in sorted(links):
        if i not in partner and j not in partner:
            partner[i], partner[j] = j, i
    for i, b in enumerate(order):
        if b[0] in names:
            continue
        k += 1
        names[b[0]] = f"W{k:04d}" + ("a" if i in partner else "")
        if i in partner:
            names[order[partner[i]][0]] = f"W{k:04d}b"
    return names


def test_against_one_by_one(spark):
    r = random.Random(4)
    boxes = []
    for k in range(400):
        x, y = r.choice((0.0, 1.0, 12.0, 31.0)), r.choice((0.0, 2.0, 9.0, 30.0))
        boxes.append((k, r.randrange(4), r.randrange(4), x, y, x + r.choice((8.0, 9.0)), y + r.choice((8.0, 10.0))))
    boxes += [(1000 + k, 1, 1, 31.0, 30.0, 40.0, 40.0) for k in range(150)]  # a crowded corner, all alike
    schema = "k long, r int, c int, x0 double, y0 double, x1 double, y1 double"
    got = {x.k: x.object_name for x in E.object_names(spark.createDataFrame(boxes, schema).repartition(4), "r", "c", "k", SIDE, "W", tol=TOL, least=LEAST).collect()}
    assert got == one_by_one(boxes)
    assert sum(n.endswith("b") for n in got.values()) > 20


def test_nulls_repeats_empty(spark):
    schema = "k long, r int, c int, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, None, 0, 30.0, 1.0, 40.0, 9.0), (2, None, 1, 0.0, 1.0, 9.0, 9.0), (3, 0, 0, 30.0, 1.0, None, 9.0), (4, 0, 1, 0.0, 1.0, 9.0, 9.0), (4, 0, 1, 0.0, 1.0, 9.0, 9.0)]
    named = E.object_names(spark.createDataFrame(rows, schema), "r", "c", "k", SIDE, "W", tol=TOL)
    assert sorted((x.k, x.object_name) for x in named.collect()) == [(1, "W0001"), (2, "W0002"), (3, "W0003"), (4, "W0004"), (4, "W0004")]
    assert E.object_names(spark.createDataFrame([], schema), "r", "c", "k", SIDE, "W", tol=TOL).count() == 0
