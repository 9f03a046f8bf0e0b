"""Adaptive cells for spatial joins: a quadtree that splits where rows are.

The plane's square is cut into four wherever more than ``most`` low corners of
boxes lie in a cell, down to ``deepest`` cuts. Corners are counted once per
finest cell, map-side; then cells above the count split in rounds of STRIDE
depths, each over what is left inside split cells. The tree itself, the keys of
split cells, goes to the driver and to tasks: the count is raised where it
must be so that there are ``most_cells`` leaves at most, whatever the rows
(``deepest`` times rows over count cells can split, and each adds three leaves).

A box belongs to all leaves that it meets, found in one Arrow pass over its four
numbers without a shuffle. Pairs of a join are given out in the leaf that holds
the corner their boxes share, so no distinct is needed. Boxes that lie on one
point can't be parted by cells. ``join_by_cells`` deals tasks by the pairs they
try, not by the bytes they read, and slices cells with too many of them.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.session import Steps

STRIDE = 5
TRIED = 2_000_000  # pairs that a task of a join tries
MOST_TASKS = 10_000
_X, _D = 28, 56  # a cell's key: depth, column, row
BOX = ("x0", "y0", "x1", "y1")


def cell_key(depth, x, y):
    return depth << _D | x << _X | y


@dataclass(frozen=True)
class Quadtree:
    x0: float
    y0: float
    side: float  # a power of two, so cell edges are exact
    split: np.ndarray  # keys of split cells, rising

    def bounds(self, key: int) -> tuple[float, float, float, float]:
        size = self.side / (1 << (key >> _D))
        x, y = key >> _X & (1 << _X) - 1, key & (1 << _X) - 1
        return self.x0 + x * size, self.y0 + y * size, self.x0 + (x + 1) * size, self.y0 + (y + 1) * size

    def leaves(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of every leaf that a box meets, by row; boxes with a missing number meet none."""
        u = [(np.minimum(x0, x1) - self.x0) / self.side, (np.minimum(y0, y1) - self.y0) / self.side]
        v = [(np.maximum(x0, x1) - self.x0) / self.side, (np.maximum(y0, y1) - self.y0) / self.side]
        row = np.flatnonzero(~np.isnan(u[0] + u[1] + v[0] + v[1]))
        x = y = np.zeros(len(row), np.int64)
        depth, rows, keys = 0, [], []
        while len(row):
            key = cell_key(depth, x, y)
            k = np.minimum(np.searchsorted(self.split, key), max(0, len(self.split) - 1))
            down = self.split[k] == key if len(self.split) else np.zeros(len(key), bool)
            rows.append(row[~down])
            keys.append(key[~down])
            depth += 1
            row = np.repeat(row[down], 4)
            x = 2 * np.repeat(x[down], 4) + np.tile([0, 0, 1, 1], down.sum())
            y = 2 * np.repeat(y[down], 4) + np.tile([0, 1, 0, 1], down.sum())
            inside = np.ones(len(row), bool)
            for at, low, high in ((x, u[0], v[0]), (y, u[1], v[1])):
                inside &= (_cut(low[row], depth) <= at) & (at <= _cut(high[row], depth))
            row, x, y = row[inside], x[inside], y[inside]
        rows, keys = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (rows, keys))
        order = np.argsort(rows, kind="stable")
        return rows[order], keys[order]

    def cells(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        """The keys of the leaves that a box meets, as an array."""

        def run(*boxes: pa.Array) -> pa.Array:
            row, key = self.leaves(*(b.to_numpy(zero_copy_only=False) for b in boxes))
            at = np.searchsorted(row, np.arange(len(boxes[0]) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(at), pa.array(key))

        run.__annotations__ = {"boxes": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "array<long>")(*(c.cast("double") for c in (x0, y0, x1, y1)))

    def holds(self, key: Column, x: Column, y: Column) -> Column:
        """If the leaf of this key holds the point."""
        depth = F.shiftright(key, _D).cast("double")
        top = F.pow(F.lit(2.0), depth)
        place = lambda v, low: F.greatest(F.lit(0), F.least(F.floor((v.cast("double") - low) / self.side * top), top.cast("long") - 1))
        mask = (1 << _X) - 1
        return (place(x, self.x0) == F.shiftright(key, _X).bitwiseAND(mask)) & (place(y, self.y0) == key.bitwiseAND(mask))


def _cut(v: np.ndarray, depth: int) -> np.ndarray:
    return np.clip(np.floor(v * (1 << depth)), 0, (1 << depth) - 1).astype(np.int64)


def quadtree(boxes: DataFrame, box: Sequence[str] = BOX, *, most: int = 2_000, deepest: int = 20, most_cells: int = 1 << 16) -> Quadtree:
    """A tree over the low corners of boxes; ``deepest`` is 24 at most."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in box)
    sides = boxes.select(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1")).dropna()
    e = sides.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    if not e.n:
        return Quadtree(0.0, 0.0, 1.0, np.zeros(0, np.int64))
    half = 2.0 ** (math.floor(math.log2(max(e.x1 - e.x, e.y1 - e.y, 2.0**-20))) + 1)
    left, low, side = math.floor(e.x / half) * half, math.floor(e.y / half) * half, 2 * half
    limit = max(most, -(-3 * deepest * e.n // most_cells))
    if e.n <= limit:
        return Quadtree(left, low, side, np.zeros(0, np.int64))
    steps = Steps(boxes.sparkSession)
    place = lambda c, at: F.floor((F.col(c) - at) / side * (1 << deepest))
    open_ = steps.put("corners", sides.groupBy(place("x", left).alias("x"), place("y", low).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    found: list[int] = []
    for top in range(0, deepest, STRIDE):
        last = min(top + STRIDE, deepest) - 1
        deep = open_.select("n", "x", "y", F.explode(F.sequence(F.lit(top), F.lit(last))).alias("depth"))
        per = deep.groupBy("depth", F.expr(f"shiftright(x, {deepest} - depth)").alias("x"), F.expr(f"shiftright(y, {deepest} - depth)").alias("y")).agg(F.sum("n").alias("n"))
        heavy = [(r.depth, r.x, r.y) for r in per.where(F.col("n") > limit).collect()]
        found += [cell_key(*h) for h in heavy]
        left_over = [h[1:] for h in heavy if h[0] == last]
        if not left_over:
            break
        inside = boxes.sparkSession.createDataFrame(left_over, "hx long, hy long")
        open_ = open_.join(F.broadcast(inside), (F.shiftright("x", deepest - last) == F.col("hx")) & (F.shiftright("y", deepest - last) == F.col("hy")), "left_semi")
    steps.drop("corners")
    return Quadtree(left, low, side, np.array(sorted(found), np.int64))


def join_by_cells(left: DataFrame, right: DataFrame, cells: Sequence[tuple[str, str]], more: Column, *, tried: int | None = None, weights: tuple[Column, Column] | None = None) -> DataFrame:
    """Pairs of rows with equal cells (names of a column of either side) for which ``more`` holds.

    The engine deals tasks by bytes, but few bytes of crowded cells are many
    pairs. Pairs to try are counted per cell first: a task gets ``tried`` of them
    (TRIED) or so (more only past MOST_TASKS), and a cell with more is done in slices of its larger side.
    With ``weights`` a left and a right row count as their product of pairs.
    """
    tried, names = tried or TRIED, [f"cell{i}_" for i in range(len(cells))]
    on = functools.reduce(operator.and_, (F.col(a) == F.col(b) for a, b in cells))
    count = lambda df, side, n: df.groupBy(*(F.col(c[side]).alias(name) for c, name in zip(cells, names))).agg((F.sum(weights[side]) if weights else F.count(F.lit(1))).alias(n))
    per = count(left, 0, "nl_").join(count(right, 1, "nr_").hint("merge"), names).withColumn("pairs_", F.col("nl_") * F.col("nr_"))
    pairs = per.agg(F.sum("pairs_")).first()[0] or 0
    if pairs <= tried:
        return left.join(right, on & more)
    tasks = min(math.ceil(pairs / tried), MOST_TASKS)
    each = max(tried, math.ceil(pairs / tasks))
    steps = Steps(left.sparkSession)  # of cells with more than ``each``: fewer than there are tasks
    crowded = steps.put("crowded", per.where(F.col("pairs_") > each).select(*names, F.ceil(F.col("pairs_") / each).alias("slices_"), (F.col("nl_") >= F.col("nr_")).alias("wider_")))

    def sliced(df: DataFrame, side: int, name: str) -> DataFrame:
        own = F.col("wider_") == F.lit(side == 0)
        slices = F.when(F.col("slices_").isNull(), F.array(F.lit(0).cast("long"))).when(own, F.array(F.pmod(F.xxhash64(*df.columns), "slices_"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices_") - 1))
        held = df.join(F.broadcast(crowded), functools.reduce(operator.and_, (F.col(c[side]) == F.col(n) for c, n in zip(cells, names))), "left")
        return held.select(*df.columns, F.explode(slices).alias(name)).repartition(tasks, *(c[side] for c in cells), name)

    met = sliced(left, 0, "slice_").join(sliced(right, 1, "slice_r_").hint("merge"), on & (F.col("slice_") == F.col("slice_r_")) & more)
    return met.drop("slice_", "slice_r_")


def adaptive_box_join(left: DataFrame, right: DataFrame, box: Sequence[str] = BOX, *, keys: Sequence[str] = (), grow: float = 0.0, most: int = 2_000) -> DataFrame:
    """Pairs of boxes that meet (after growing the left by ``grow``), columns as l_ and r_, by cells of a tree over both sides."""
    lows, highs = box[:2], box[2:]
    grown = [F.col(c) - grow for c in lows] + [F.col(c) + grow for c in highs]
    tree = quadtree(left.select(*(g.cast("double").alias(c) for g, c in zip(grown, box))).unionAll(right.select(*(F.col(c).cast("double").alias(c) for c in box))), box, most=most)
    l_ = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), F.explode(tree.cells(*grown)).alias("cell_"))
    r_ = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.explode(tree.cells(*(F.col(c) for c in box))).alias("cell_r_"))
    meet, corner = F.lit(True), []
    for low, high in zip(lows, highs):
        meet = meet & (F.col(f"l_{low}") - grow <= F.col(f"r_{high}")) & (F.col(f"r_{low}") <= F.col(f"l_{high}") + grow)
        corner.append(F.greatest(F.col(f"l_{low}") - grow, F.col(f"r_{low}")))
    cells = [("cell_", "cell_r_"), *((f"l_{k}", f"r_{k}") for k in keys)]
    return join_by_cells(l_, r_, cells, meet & tree.holds(F.col("cell_"), *corner)).drop("cell_", "cell_r_")
