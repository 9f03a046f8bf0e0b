"""Pieces between bent lines against a version that tries every line; numbers of spaces one by one."""

import math
import random

import numpy as np

from fieldlark.operators import piece_links as P

MOST, COVER = 5.0, 1.5


def test_against_every_line(spark):
    r = random.Random(6)
    axes = {b: (math.cos(a), math.sin(a)) for b, a in ((1, 0.3), (2, 2.0))}
    lines = []
    for k in range(80):
        b, s, o = 1 + k % 2, r.uniform(0, 40), r.uniform(0, 30)
        ux, uy = axes[b]
        path = [(s + 15 * q, o + r.uniform(-2, 2)) for q in range(4)]
        pts = [(t * ux - v * uy, t * uy + v * ux) for t, v in path]
        r.shuffle(pts)
        lines.append((k, b, k % 3, pts))
    pieces = [(p, r.choice([1, 2, 3, None]), r.randrange(3), r.uniform(-60, 60), r.uniform(-60, 90)) for p in range(600)] + [(999, 1, 0, None, 1.0)]

    def links(block, tile, x, y):
        if block not in axes or x is None:
            return None, None, "none"
        u = np.array(axes[block])
        n = np.array([-u[1], u[0]])

        def sides(mine, cover):
            left, right = [], []
            for k, _, _, pts in mine:
                at = sorted((float(np.dot(p, u)), float(np.dot(p, n))) for p in pts)
                t = float(np.dot((x, y), u))
                if cover and not at[0][0] - COVER <= t <= at[-1][0] + COVER:
                    continue
                far = float(np.interp(t, [a for a, _ in at], [b for _, b in at])) - float(np.dot((x, y), n))
                if 0 < abs(far) <= MOST:
                    (left if far > 0 else right).append((abs(far), k))
            return [min(s)[1] if s else None for s in (left, right)]

        l1, r1 = sides([x for x in lines if x[1] == block and x[2] == tile], False)
        if l1 is not None and r1 is not None:
            return l1, r1, "tile"
        l2, r2 = sides([x for x in lines if x[1] == block], True)
        left, right = l1 if l1 is not None else l2, r1 if r1 is not None else r2
        return left, right, "block" if left is not None and right is not None else "none"

    line_df = spark.createDataFrame([*lines, (500, 1, 0, []), (501, 1, 0, None)], "k int, b int, t int, line array<struct<x:double,y:double>>")
    piece_df = spark.createDataFrame(pieces, "p int, b int, t int, x double, y double").repartition(4)
    axis_df = spark.createDataFrame([(b, *u) for b, u in axes.items()], "b int, ux double, uy double")
    linked = P.link_pieces_to_lines(piece_df, line_df, line_df.drop("t"), axis_df, block="b", tile="t", piece="p", row="k", points="line", most=MOST, cover=COVER, cell=10.0)
    got = {x.p: (x.left, x.right, x.method) for x in linked.collect()}
    assert got == {p: links(b, t, x, y) for p, b, t, x, y in pieces}
    assert {m for _, _, m in got.values()} == {"tile", "block", "none"}
    empty = P.link_pieces_to_lines(piece_df, line_df.limit(0), line_df.drop("t").limit(0), axis_df, block="b", tile="t", piece="p", row="k", points="line", most=MOST, cover=COVER)
    assert {x.method for x in empty.collect()} == {"none"}


def test_numbers(spark):
    pairs = [("V1", 1, 2), ("V1", 2, 1), ("V1", 1, 3), ("V1", 5, 6), ("V1", 5, 9), ("V1", 6, 7), ("V2", 3, 4), ("V2", None, 4)]
    linked = spark.createDataFrame([(p, *x) for p, x in enumerate(pairs)], "p int, b string, left int, right int")
    order = spark.createDataFrame([(k, k) for k in range(1, 10)], "k int, i int")
    got = {x.p: x.space for x in P.numbered_spaces(linked, order, block="b", row="k", index="i").collect()}
    want, last = {}, {}
    for b, pair in sorted({(b, tuple(sorted((x, y)))) for b, x, y in pairs if x and y}):
        last[b] = want[b, pair] = max(last.get(b, 0) + 1, pair[0])
    assert got == {p: want[b, tuple(sorted((x, y)))] if x and y else None for p, (b, x, y) in enumerate(pairs)}
