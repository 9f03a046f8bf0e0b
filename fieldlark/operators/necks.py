"""Places of a mask cut where they visibly narrow: moments, width profiles and valleys as aggregates and windows.

A place's axis comes from the second moments of its runs. Pixels are counted
per slice across the axis; a slice is a neck if no slice within ``piece`` is
narrower (means of three slices) and it has at most ``ratio`` of the widest
slice within ``window`` on either side. Necks are taken by depth, ties to the
lower slice, at least ``piece`` apart; a place is cut only if every part keeps
``part`` pixels. Lengths are in pixels.

Slices are numbers of whole units (the axis in 2**-20 of a pixel), so counts do
not depend on how rows are dealt. A place's slices are windowed in blocks that
overlap by the reach of a neck, so no task holds a long place; the pixels of
its runs are counted map-side. Places are connected (``label_runs``) and slices
at least 2 pixels wide, so no slice inside a place is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.operators.labelling import label_runs, pixel_runs
from fieldlark.operators.matching import first_come
from fieldlark.session import Steps

_UNIT = 1 << 20


@dataclass(frozen=True)
class Necks:
    """along: least length of a place that is looked at; the others as above, ``slice_px`` the width of a slice."""

    along: float
    ratio: float
    piece: float
    window: float
    part: int
    slice_px: int = 2

    def __post_init__(self) -> None:
        if not (0 < self.ratio < 1 and self.slice_px >= 2 and 0 < 2 * self.piece <= self.along and self.window > 0 and self.part >= 1):
            raise ValueError(f"not usable: {self}")

    @property
    def apart(self) -> int:
        return max(1, round(self.piece / self.slice_px))

    @property
    def reach(self) -> int:
        return max(1, round(self.window / self.slice_px))


def axes(labelled: DataFrame) -> DataFrame:
    """(place, n, x0, y0, wide, high, ux, uy): size, corner, extent and main direction in units; a round place has that of x."""
    n = F.col("x1") - F.col("x0")
    per = labelled.groupBy("place").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") - F.min("x0")).alias("wide"), (F.max("y") + 1 - F.min("y")).alias("high"), F.sum(n).alias("n"))
    # sums about each place's corner: whole numbers, so exact in any order
    at = labelled.select("place", "y", F.col("x0").alias("a"), F.col("x1").alias("b")).join(per, "place").withColumns({"y": F.col("y") - F.col("y0"), "a": F.col("a") - F.col("x0"), "b": F.col("b") - F.col("x0")})
    squares = lambda c: f"({c} - 1) * {c} * (2 * {c} - 1) div 6"  # noqa: E731 of 0 to c - 1
    sums = at.groupBy("place", "x0", "y0", "wide", "high", "n").agg(
        F.sum(F.expr("(b - a) * (a + b - 1) div 2")).alias("sx"), F.sum(F.expr("(b - a) * y")).alias("sy"), F.sum(F.expr(f"{squares('b')} - {squares('a')}")).alias("sxx"),
        F.sum(F.expr("(b - a) * y * y")).alias("syy"), F.sum(F.expr("(b - a) * (a + b - 1) div 2 * y")).alias("sxy"),
    )
    d = {c: F.col(c).cast("double") for c in ("n", "sx", "sy", "sxx", "syy", "sxy")}
    turn = 0.5 * F.atan2(2 * (d["sxy"] - d["sx"] * d["sy"] / d["n"]), (d["sxx"] - d["sx"] * d["sx"] / d["n"]) - (d["syy"] - d["sy"] * d["sy"] / d["n"]))
    unit = lambda c: F.floor(c * _UNIT + 0.5)
    return sums.select("place", "n", "x0", "y0", "wide", "high", unit(F.cos(turn)).alias("ux"), unit(F.sin(turn)).alias("uy"))


def slices(labelled: DataFrame, axis: DataFrame, slice_px: int) -> DataFrame:
    """(place, y, x, slice): pixels of the axes' places, slices from 0 at the lower end."""
    runs = labelled.select("place", "y", F.col("x0").alias("a"), F.col("x1").alias("b")).join(axis.select("place", "x0", "y0", "ux", "uy"), "place")
    along = lambda x: (x - F.col("x0")) * F.col("ux") + (F.col("y") - F.col("y0")) * F.col("uy")
    low = runs.groupBy("place").agg(F.min(F.least(along(F.col("a")), along(F.col("b") - 1))).alias("low"))
    each = runs.join(low, "place").withColumn("x", F.explode(F.sequence("a", F.col("b") - 1)))
    return each.select("place", "y", "x", F.floor((along(F.col("x")) - F.col("low")) / (slice_px * _UNIT)).alias("slice"))


def valleys(profile: DataFrame, how: Necks, *, block: int = 4096) -> DataFrame:
    """(place, slice, depth) of slices that are necks by themselves. profile: (place, slice, n), slices 0 to the last without gaps."""
    edge = max(how.apart, how.reach) + 1
    own = F.floor(F.col("slice") / block)
    copies = profile.withColumn("block", F.explode(F.sequence(F.floor((F.col("slice") - edge) / block), F.floor((F.col("slice") + edge) / block)))).withColumn("own", own == F.col("block"))
    w = Window.partitionBy("place", "block").orderBy("slice")
    three = copies.withColumn("w", F.sum("n").over(w.rowsBetween(-1, 1)))
    near = three.select(
        "place", "slice", "own", "w", F.min("w").over(w.rowsBetween(-how.apart, how.apart)).alias("least"),
        F.max("w").over(w.rowsBetween(-how.reach, -1)).alias("before"), F.max("w").over(w.rowsBetween(1, how.reach)).alias("after"),
    )
    last = profile.groupBy("place").agg(F.max("slice").alias("last"))
    depth = F.col("w") / F.least("before", "after")
    inner = near.where("own").join(last, "place").where((F.col("slice") >= how.apart) & (F.col("slice") <= F.col("last") - how.apart))
    return inner.where((F.col("w") == F.col("least")) & (depth <= how.ratio)).select("place", "slice", depth.alias("depth"))


def spread(found: DataFrame, apart: int) -> DataFrame:
    """Valleys taken by depth, ties to the lower slice, at least ``apart`` from all taken before."""
    node = lambda p: F.struct(F.col(f"{p}.place").alias("place"), F.col(f"{p}.depth").alias("depth"), F.col(f"{p}.slice").alias("slice"))
    bins = found.withColumn("bin", F.floor(F.col("slice") / apart))
    around = bins.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    pairs = bins.alias("l").join(around.alias("r"), ["place", "bin"]).where((F.abs(F.col("l.slice") - F.col("r.slice")) < apart) & (node("l") < node("r")))
    gone = first_come(pairs.select(node("l").alias("first"), node("r").alias("then"))).select("then.place", "then.slice")
    return found.join(gone, ["place", "slice"], "left_anti").select(*found.columns)


def whole_parts(profile: DataFrame, taken: DataFrame, least: int, *, block: int = 4096) -> DataFrame:
    """taken without the places of which a part between two necks, or a neck and an end, has fewer than ``least`` pixels."""
    part = profile.withColumn("block", F.floor(F.col("slice") / block))
    totals = part.groupBy("place", "block").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("place").orderBy("block"))  # a row per 4,096 slices
    before = totals.select("place", "block", (upto - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("place")).alias("all"))
    mine = part.withColumn("inside", F.sum("n").over(Window.partitionBy("place", "block").orderBy("slice")))
    marks = taken.withColumn("block", F.floor(F.col("slice") / block)).join(mine, ["place", "block", "slice"]).join(before, ["place", "block"])
    end = F.col("base") + F.col("inside")  # pixels up to the neck, it included
    w = Window.partitionBy("place").orderBy("slice")
    parts = marks.select("place", "all", end.alias("end"), (end - F.col("n") - F.coalesce(F.lag(end).over(w), F.lit(0))).alias("size"))
    bad = parts.groupBy("place", "all").agg(F.min("size").alias("size"), F.max("end").alias("end")).where(F.least(F.col("size"), F.col("all") - F.col("end")) < least)
    return taken.join(bad, "place", "left_anti").select(*taken.columns)


def necks(labelled: DataFrame, how: Necks) -> tuple[DataFrame, DataFrame]:
    """((place, slice, depth, n) of the necks to cut, n their pixels, and (place, y, x, slice) of the pixels of all places looked at, made anew where they are used)."""
    steps = Steps(labelled.sparkSession)
    axis = steps.put("axes", axes(labelled).where((F.greatest("wide", "high") >= how.along / 2**0.5) & (F.col("n") >= 2 * how.part)))
    pixels = slices(labelled, axis, how.slice_px)
    counts = pixels.groupBy("place", "slice").agg(F.count(F.lit(1)).alias("n"))
    long = counts.groupBy("place").agg(F.max("slice").alias("last")).where((F.col("last") + 1) * how.slice_px >= how.along)
    profile = steps.put("profile", counts.join(long.select("place"), "place", "left_semi"))
    found = steps.put("valleys", valleys(profile, how))
    return steps.put("necks", whole_parts(profile, spread(found, how.apart), how.part).join(profile, ["place", "slice"])), pixels


def split_at_necks(labelled: DataFrame, how: Necks, keys: Sequence[str] = (), *, diagonal: bool = False) -> DataFrame:
    """(keys, y, x0, x1, place): the runs without the pixels of necks, labelled anew; places without necks keep all their pixels.

    labelled: as from ``label_runs`` with the same keys. The pixels cleared are
    those of whole slices, so parts don't touch each other.
    """
    cuts, pixels = necks(labelled, how)
    mine = cuts.select("place").distinct()
    left = pixels.join(mine, "place", "left_semi").join(cuts.select("place", "slice"), ["place", "slice"], "left_anti")
    if keys:
        left = left.join(labelled.join(mine, "place", "left_semi").select("place", *keys).distinct(), "place")
    rest = labelled.join(mine, "place", "left_anti").select(*keys, "y", "x0", "x1")
    return label_runs(rest.unionByName(pixel_runs(left, keys)), keys, diagonal=diagonal)
