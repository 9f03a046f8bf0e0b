"""Branches of a skeleton pruned and merged, and areas scanned into grids, as tables.

``prune_spurs`` drops terminal branches in rounds over an edge table until none
falls; ``merged_lines`` makes one line of branches that meet where no third does,
as components of such meetings. ``coverage`` scan-converts rings: every edge gives
a crossing on each of its scan lines, crossings of a line pair up in order, and
pairs become shares of pixels, summed map-side; no polygon is rastered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.operators.graph import components
from fieldlark.session import Steps


def _degrees(branches: DataFrame) -> DataFrame:
    return branches.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))


def prune_spurs(branches: DataFrame, least: float, *, most_rounds: int = 1_000) -> DataFrame:
    """Branches (branch, u, v, length) without terminal ones under ``least`` that hang off a junction, in rounds until none falls.

    A spur has one end of degree 1 and the other of 3 or more, degrees taken
    anew each round. A junction that would lose all its branches keeps the
    longest (ties: the least).
    """
    steps = Steps(branches.sparkSession)
    live = steps.put("live", branches.select("branch", "u", "v", "length"))
    for _ in range(most_rounds):
        deg = steps.put("deg", _degrees(live))
        end = lambda c: deg.select(F.col("node").alias(c), F.col("deg").alias(f"deg_{c}"))
        known = live.join(end("u"), "u").join(end("v"), "v")
        low, high = F.least("deg_u", "deg_v"), F.greatest("deg_u", "deg_v")
        spur = (F.col("u") != F.col("v")) & (F.col("length") < least) & (low == 1) & (high >= 3)
        known = steps.put("known", known.select("branch", "u", "v", "length", spur.alias("spur")))
        if known.where("spur").isEmpty():
            return live
        ends = known.select("branch", "length", "spur", F.explode(F.array_distinct(F.array("u", "v"))).alias("node")).join(deg.where("deg >= 3"), "node")
        bare = ends.groupBy("node").agg(F.bool_and("spur").alias("all_"), F.max(F.struct("length", (-F.col("branch")).alias("b"))).alias("best"))
        rescued = bare.where("all_").select((-F.col("best.b")).alias("branch")).distinct()
        falls = known.where("spur").join(rescued, "branch", "left_anti").select("branch")
        after = steps.put("after", live.join(falls, "branch", "left_anti"))
        if after.count() == live.count():
            return live
        live = steps.put("live", after)
    raise RuntimeError("spurs still fall after the most rounds")


def merged_lines(branches: DataFrame) -> DataFrame:
    """(line, n, length, u, v): branches joined where exactly two ends meet; u <= v are the line's ends, null for a closed one; line: its least branch."""
    pairs = branches.select("branch", F.explode(F.array("u", "v")).alias("node"))
    two = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("branch").alias("a"), F.max("branch").alias("b")).where("n = 2 AND a <> b")
    of = components(two.select("a", "b"), branches.select(F.col("branch").alias("node"))).select(F.col("node").alias("branch"), F.col("component").alias("line"))
    size = branches.join(of, "branch").groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    inner = two.select("node")
    loose = pairs.join(inner, "node", "left_anti").join(of, "branch").groupBy("line").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    return size.join(loose, "line", "left").select("line", "n", "length", "u", "v")


def coverage(edges: DataFrame, *, key: str, width: int, height: int, samples: int = 4) -> DataFrame:
    """(j, i, share): how much of each pixel of a grid polygons cover, at most 1; pixels without any are left out.

    edges: (key, x0, y0, x1, y1), the rings of each polygon in pixels, either way
    round; holes by the even-odd rule. A line of pixels is sampled by so many scan
    lines; along them shares are exact.
    """
    step = 1.0 / samples
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.greatest(F.ceil(low * samples - 0.5), F.lit(0))  # scan k lies at (k + 0.5) / samples; half open
    last = F.least(F.ceil(high * samples - 0.5) - 1, F.lit(height * samples - 1))
    at = edges.where(F.col("y0") != F.col("y1")).withColumns({"first_": first, "last_": last}).where("first_ <= last_")
    scans = at.select(key, "x0", "y0", "x1", "y1", F.explode(F.sequence("first_", "last_")).alias("scan"))
    y = (F.col("scan") + 0.5) / samples
    x = F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    w = Window.partitionBy(key, "scan").orderBy("x")
    ordered = scans.select(key, "scan", x.alias("x")).select(key, "scan", "x", F.lead("x").over(w).alias("to"), F.row_number().over(w).alias("nth_"))
    spans = ordered.where((F.col("nth_") % 2 == 1) & F.col("to").isNotNull()).select(F.floor(F.col("scan") / samples).alias("j"), F.greatest(F.col("x"), F.lit(0.0)).alias("a"), F.least(F.col("to"), F.lit(float(width))).alias("b")).where("a < b")
    pixels = spans.select("j", "a", "b", F.explode(F.sequence(F.floor("a"), F.ceil("b") - 1)).alias("i"))
    part = (F.least(F.col("b"), F.col("i") + 1) - F.greatest(F.col("a"), F.col("i"))) * step
    return pixels.groupBy("j", "i").agg(F.least(F.lit(1.0), F.sum(part)).alias("share"))
