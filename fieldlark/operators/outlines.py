"""Exact unions of boxes and what is left of them: outlines of axis-cut polygons, closings, walkable areas.

``covered`` is where any box of a group lies and none of ``minus``. The plane is
cut by a quadtree over all boxes; each task gets one leaf of one group, marks its
cells between the boxes' coordinates, and gives out the edges between covered and
uncovered ones, covered side on the left. A leaf owns its low and left sides and
sees what touches them from outside, so every edge is given out once and none
along leaf borders inside a covered place; edges that a border cuts meet end to
end. Leaves hold ``most`` low corners at most; more columns than memory allows
are done in strips.

Edges are chained to rings by tables: each takes the edge that starts where it
ends (where four meet, the one to the left, so places that touch in a corner are
apart, and gaps that touch there are one ring), and pointers are doubled in
rounds until each edge knows the least of its ring and its distance to it; rounds
grow with the logarithm of the longest ring. A ring of positive area is an
outline, of negative area a hole.

Boxes without area, and those with missing numbers, cover nothing. Equal boxes
count once. Numbers should be whole multiples of a common step (whole numbers,
millimetres), so that equal places are equal numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators.quadtree import BOX, Quadtree, quadtree
from fieldlark.operators.routes import ring_positions
from fieldlark.session import Steps

STRIP = 1 << 22  # cells of a leaf in memory at once
EAST, NORTH, WEST, SOUTH = range(4)


def grown(boxes: DataFrame, by: float, box: Sequence[str] = BOX) -> DataFrame:
    """boxes, larger by ``by`` on every side."""
    out = boxes
    for c, sign in zip(box, (-1, -1, 1, 1)):
        out = out.withColumn(c, F.col(c) + sign * by)
    return out


def _spans(low: np.ndarray, high: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every box, its first and (exclusive) last column; column 0 lies just before cuts[0], column k between cuts k - 1 and k."""
    first = np.where(low < cuts[0], 0, 1 + np.searchsorted(cuts, low))
    last = np.where(high >= cuts[-1], len(cuts), 1 + np.searchsorted(cuts, high))
    return first, np.where(high < cuts[0], 0, last)


def _segments(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, start, stop) of runs of True along the second axis."""
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    line, start = np.nonzero(step == 1)
    return line, start, np.nonzero(step == -1)[1]


def leaf_edges(bounds: tuple[float, float, float, float], boxes: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """(n, 5): direction and ends of the edges that a leaf owns. boxes: (n, 4); sign: 1 covers, -1 takes away."""
    x0, y0, x1, y1 = boxes.T
    cut = lambda low, high, a, b: np.unique(np.concatenate(([a, b], np.clip(low, a, b), np.clip(high, a, b))))
    xs, ys = cut(x0, x1, bounds[0], bounds[2]), cut(y0, y1, bounds[1], bounds[3])
    c0, c1 = _spans(x0, x1, xs)
    r0, r1 = _spans(y0, y1, ys)
    wide, out = max(2, STRIP // (len(ys) + 1)), []
    for at in range(0, len(xs) - 1, wide - 1):  # columns at .. stop - 1; the first was the last of the strip before
        stop = min(at + wide, len(xs))
        covered = None
        for s in (1, -1):
            hit = (sign == s) & (c0 < stop) & (c1 > at)
            deep = np.zeros((stop - at + 1, len(ys) + 1), np.int32)
            a, b = np.maximum(c0[hit], at) - at, np.minimum(c1[hit], stop) - at
            for c, r, d in ((a, r0, 1), (b, r0, -1), (a, r1, -1), (b, r1, 1)):
                np.add.at(deep, (c, r[hit]), d)
            lies = deep.cumsum(0).cumsum(1)[:-1, :-1] > 0
            covered = lies if covered is None else covered & ~lies
        left, right = covered[:-1, 1:], covered[1:, 1:]
        for way, mask in ((NORTH, left & ~right), (SOUTH, right & ~left)):
            line, a, b = _segments(mask)
            x = xs[at + line]
            a, b = (ys[a], ys[b]) if way == NORTH else (ys[b], ys[a])
            out.append(np.column_stack((np.full(len(x), way), x, a, x, b)))
        below, above = covered[1:, :-1], covered[1:, 1:]
        for way, mask in ((EAST, above & ~below), (WEST, below & ~above)):
            line, a, b = _segments(mask.T)
            y = ys[line]
            a, b = (xs[at + a], xs[at + b]) if way == EAST else (xs[at + b], xs[at + a])
            out.append(np.column_stack((np.full(len(y), way), a, y, b, y)))
    return np.concatenate(out) if out else np.zeros((0, 5))


def boundary(boxes: DataFrame, group: str, *, minus: DataFrame | None = None, box: Sequence[str] = BOX, most: int = 500) -> DataFrame:
    """(group, way, x0, y0, x1, y1): directed edges of what the boxes of each group cover; minus: (group, box) taken away."""
    side = lambda df, sign: df.select(F.col(group).alias("g"), *(F.col(c).cast("double").alias(n) for c, n in zip(box, BOX)), F.lit(sign).alias("sign")).where("x0 < x1 AND y0 < y1").distinct()
    kind = boxes.schema[group].dataType.simpleString()
    parts = side(boxes, 1) if minus is None else side(boxes, 1).unionAll(side(minus, -1))
    parts = Steps(boxes.sparkSession).put("parts", parts)
    tree: Quadtree = quadtree(parts, most=most)
    dealt = parts.withColumn("cell", F.explode(tree.cells(*(F.col(c) for c in BOX))))
    names = ["g", "way", *BOX]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g, cell = key
        boxes = np.column_stack([table.column(c).to_numpy() for c in BOX])
        edges = leaf_edges(tree.bounds(cell.as_py()), boxes, table.column("sign").to_numpy())
        return pa.Table.from_arrays([pa.repeat(g, len(edges)), pa.array(edges[:, 0].astype(np.int32)), *(pa.array(edges[:, k]) for k in range(1, 5))], names=names)

    return dealt.groupBy("g", "cell").applyInArrow(run, f"g {kind}, way int, x0 double, y0 double, x1 double, y1 double").withColumnRenamed("g", group)


def measures(edges: DataFrame, group: str) -> DataFrame:
    """(group, area, length, n_edges) of what the edges of boundary() bound."""
    return edges.groupBy(group).agg(F.sum(F.col("x0") * (F.col("y1") - F.col("y0"))).alias("area"), F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).alias("length"), F.count(F.lit(1)).alias("n_edges"))


def trace(edges: DataFrame, group: str) -> DataFrame:
    """(group, ring, area, length, corners): the rings of boundary(); corners: (x, y) in order, covered side on the left, from the least edge's on."""
    steps = Steps(edges.sparkSession)
    e = steps.put("edges", edges.withColumn("edge", F.monotonically_increasing_id()))  # as written, so it stays
    after = e.select(F.col(group).alias("g_"), F.col("x0").alias("px"), F.col("y0").alias("py"), F.col("edge").alias("next"), F.col("way").alias("way_"))
    met = e.join(after, F.col(group).eqNullSafe(F.col("g_")) & (F.col("x1") == F.col("px")) & (F.col("y1") == F.col("py")))
    turn = F.pmod(F.col("way_") - F.col("way"), F.lit(4))  # 1: to the left, 0: straight on, 3: to the right
    chosen = met.groupBy("edge").agg(F.min(F.struct(F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2).alias("rank"), F.col("next"))).alias("to"))
    links = steps.put("links", chosen.select("edge", "to.next", (F.col("to.rank") != 1).alias("bends")))
    of = ring_positions(links.select(F.col("edge").alias("item"), "next")).select(F.col("item").alias("edge"), "ring", F.col("ahead").alias("off"))
    bent = links.where("bends").select(F.col("next").alias("edge"), F.lit(True).alias("corner"))
    rings = e.join(of, "edge").join(bent, "edge", "left")
    point = F.when(F.col("corner"), F.struct(F.when(F.col("off") == 0, F.lit(-(2**62))).otherwise(-F.col("off")).alias("at"), F.col("x0").alias("x"), F.col("y0").alias("y")))
    per = rings.groupBy(group, "ring").agg(F.sum(F.col("x0") * (F.col("y1") - F.col("y0"))).alias("area"), F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).alias("length"), F.sort_array(F.collect_list(point)).alias("points"))
    return per.select(group, "ring", "area", "length", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("corners"))


def thickened(edges: DataFrame, by: float) -> DataFrame:
    """The boxes that reach ``by`` to all sides of edges."""
    low, high = F.least("x0", "x1") - by, F.greatest("x0", "x1") + by
    return edges.select(*(c for c in edges.columns if c not in (*BOX, "way")), low.alias("x0"), (F.least("y0", "y1") - by).alias("y0"), high.alias("x1"), (F.greatest("y0", "y1") + by).alias("y1"))


def closing(boxes: DataFrame, group: str, by: float) -> tuple[DataFrame, DataFrame]:
    """(boxes, minus) for boundary(): the closing of each group by squares that reach ``by``.

    What the grown boxes cover, less all within ``by`` of its edge.
    """
    large = grown(boxes.select(group, *BOX), by)
    return large, thickened(boundary(large, group), by)


def outline_of(boxes: DataFrame, group: str, *, reach: float, lone_reach: float) -> DataFrame:
    """The edges of each group's closing; a group that closes to nothing (a lone line) has the edges of its boxes grown by ``lone_reach``."""
    large, minus = closing(boxes, group, reach)
    edges = Steps(boxes.sparkSession).put("closed", boundary(large, group, minus=minus))
    bare = boxes.join(edges.select(F.col(group).alias("g_")).distinct(), F.col(group).eqNullSafe(F.col("g_")), "left_anti")
    return edges.unionByName(boundary(grown(bare.select(group, *BOX), lone_reach), group))


def walkable(ground: DataFrame, barred: DataFrame, group: str, *, reach: float, margins: Sequence[float]) -> DataFrame:
    """(group, margin, edges): where one may walk: the closing of the ground, less what is barred, and copies eroded by each margin.

    ground: boxes of lanes and passages; barred: of crowns and forbidden places.
    """
    large, minus = closing(ground, group, reach)
    steps = Steps(ground.sparkSession)
    gone = steps.put("gone", minus.select(group, *BOX).unionByName(barred.select(group, *BOX)))
    edges = steps.put("edges", boundary(large, group, minus=gone))
    out = edges.withColumn("margin", F.lit(0.0))
    for m in margins:
        out = out.unionByName(boundary(large, group, minus=gone.unionByName(thickened(edges, m).select(group, *BOX))).withColumn("margin", F.lit(float(m))))
    return out
