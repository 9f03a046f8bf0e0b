"""Rows of plants by votes: the angle whose offsets gather most, peaks of its profile, robust lines of all bands at once.

Each point votes for an offset at every angle of a grid; votes are counted
map-side, so what is shuffled is a number per (tile, angle, bin) and task. The
angle whose histogram varies most wins, first on a coarse grid, then on a fine
one around it. Peaks are greatest within a window of bins. Lines are fitted by
reweighted least squares in rounds: a round is one aggregate of weighted sums
over all bands of all tiles (points near a line weigh 1, others delta over their
distance); the lines, a few numbers a band, are written and met again. So no tile
and no band is held by one task.

A point's offset at an angle is y cos - x sin, its place along it x cos + y sin.
Ties go to the least angle and the first bin. Points without coordinates count
nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.session import Steps


def _turn(angle: float) -> tuple[float, float]:
    return math.cos(math.radians(angle)), math.sin(math.radians(angle))


def votes(points: DataFrame, tile: str, angles: Sequence[float], bin_size: float) -> DataFrame:
    """(tile, angle, bin, n). points: (tile, x, y)."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    grid = F.array(*(F.struct(F.lit(float(a)).alias("angle"), F.lit(_turn(a)[0]).alias("c_"), F.lit(_turn(a)[1]).alias("s_")) for a in angles))  # folded to one literal
    turned_ = points.where("x IS NOT NULL AND y IS NOT NULL").select(tile, x.alias("x"), y.alias("y"), F.inline(grid))
    return turned_.groupBy(tile, "angle", F.floor((F.col("y") * F.col("c_") - F.col("x") * F.col("s_")) / bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def best_angles(voted: DataFrame, tile: str) -> DataFrame:
    """(tile, angle, score): the angle of greatest variance over bins from the first to the last."""
    wide = F.max("bin") - F.min("bin") + 1
    total = F.sum("n")
    score = (F.sum(F.col("n") * F.col("n")) * wide - total * total) / (wide * wide)
    per = voted.groupBy(tile, "angle").agg(score.alias("score"))
    return per.groupBy(tile).agg(F.max(F.struct("score", (-F.col("angle")).alias("a"))).alias("m")).select(tile, (F.lit(0.0) - F.col("m.a")).alias("angle"), F.col("m.score").alias("score"))


def dominant_angles(points: DataFrame, tile: str, *, bin_size: float, coarse: float = 2.0, fine: float = 0.1) -> DataFrame:
    """(tile, angle): by a coarse grid over half a turn, then a fine one around its best."""
    steps = Steps(points.sparkSession)
    first = steps.put("first", best_angles(votes(points, tile, [coarse * k for k in range(round(180 / coarse))], bin_size), tile))
    n = round(coarse / fine)
    near = first.select(tile, F.explode(F.array(*(F.col("angle") + (k * fine) for k in range(-n, n + 1)))).alias("angle"))
    near = near.select(F.col(tile).alias("tile_"), "angle", F.cos(F.radians("angle")).alias("c"), F.sin(F.radians("angle")).alias("s"))
    met = points.where("x IS NOT NULL AND y IS NOT NULL").join(near, F.col(tile) == F.col("tile_"))
    voted = met.groupBy(tile, "angle", F.floor((F.col("y") * F.col("c") - F.col("x") * F.col("s")) / bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return best_angles(voted, tile).select(tile, F.pmod("angle", F.lit(180.0)).alias("angle"))


def turned(points: DataFrame, angles: DataFrame, tile: str) -> DataFrame:
    """points with t, the place along their tile's angle, and o, the offset from it."""
    of = angles.select(F.col(tile).alias("tile_"), F.cos(F.radians("angle")).alias("c_"), F.sin(F.radians("angle")).alias("s_"))
    t, o = F.col("x") * F.col("c_") + F.col("y") * F.col("s_"), F.col("y") * F.col("c_") - F.col("x") * F.col("s_")
    return points.join(of, F.col(tile) == F.col("tile_")).withColumns({"t": t, "o": o}).drop("tile_", "c_", "s_")


def peaks(profile: DataFrame, keys: Sequence[str], *, apart: int, least: int) -> DataFrame:
    """(keys, peak, bin, n): bins of at least so many votes, above all within ``apart`` before them and none below any after; numbered in order."""
    w = Window.partitionBy(*keys).orderBy("bin")
    before, after = F.max("n").over(w.rangeBetween(-apart, -1)), F.max("n").over(w.rangeBetween(1, apart))
    top = profile.withColumns({"b_": before, "a_": after}).where((F.col("n") >= least) & (F.col("n") > F.coalesce("b_", F.lit(0))) & (F.col("n") >= F.coalesce("a_", F.lit(0))))
    return top.select(*keys, F.row_number().over(w).alias("peak"), "bin", "n")


def near_peaks(points: DataFrame, found: DataFrame, tile: str, *, bin_size: float, reach: float) -> DataFrame:
    """points with the peak whose middle their offset is nearest to, within ``reach`` (ties: the lower); points: (tile, t, o)."""
    steps = F.sequence(F.floor((F.col("mid") - reach) / bin_size), F.floor((F.col("mid") + reach) / bin_size))
    spread = found.withColumn("mid", (F.col("bin") + 0.5) * bin_size).select(F.col(tile).alias("tile_"), "peak", "mid", F.explode(steps).alias("bin_"))
    ranked = spread.groupBy("tile_", "bin_").agg(F.sort_array(F.collect_list(F.struct("mid", "peak"))).alias("mids"))  # at most the peaks of a reach
    met = points.join(ranked, (F.col(tile) == F.col("tile_")) & (F.floor(F.col("o") / bin_size) == F.col("bin_")))
    best = F.array_min(F.transform("mids", lambda m: F.struct(F.abs(F.col("o") - m["mid"]).alias("far"), m["peak"].alias("peak"))))
    return met.withColumn("best_", best).where(F.col("best_.far") <= reach).withColumn("peak", F.col("best_.peak")).drop("tile_", "bin_", "mids", "best_")


def fit_lines(points: DataFrame, keys: Sequence[str], *, delta: float, rounds: int = 25, close: float = 1e-9) -> DataFrame:
    """(keys, slope, intercept, n): the Huber line o = slope t + intercept of each group of points (keys, t, o)."""
    steps = Steps(points.sparkSession)
    points = steps.put("points", points.select(*keys, F.col("t").cast("double").alias("t"), F.col("o").cast("double").alias("o")))
    lines = steps.put("lines", points.groupBy(*keys).agg(F.avg("t").alias("t0"), F.avg("o").alias("o0"), F.count(F.lit(1)).alias("n")).withColumns({"slope": F.lit(None).cast("double"), "base": F.lit(None).cast("double")}))
    for _ in range(rounds):
        met = points.join(lines.select(*(F.col(k).alias(f"{k}_") for k in keys), "t0", "o0", "slope", "base"), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
        t, o = F.col("t") - F.col("t0"), F.col("o") - F.col("o0")
        off = F.abs(o - F.col("slope") * t - F.col("base"))
        weight = F.when(F.col("slope").isNull() | (off <= delta), 1.0).otherwise(delta / off)
        sums = met.select(*keys, t.alias("t"), o.alias("o"), weight.alias("w")).groupBy(*keys).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("t")).alias("wt"), F.sum(F.col("w") * F.col("o")).alias("wo"), F.sum(F.col("w") * F.col("t") * F.col("t")).alias("wtt"), F.sum(F.col("w") * F.col("t") * F.col("o")).alias("wto"))
        spread = F.col("wtt") - F.col("wt") * F.col("wt") / F.col("w")
        slope = F.when(spread > 0, (F.col("wto") - F.col("wt") * F.col("wo") / F.col("w")) / spread).otherwise(0.0)
        new = sums.select(*(F.col(k).alias(f"{k}_") for k in keys), slope.alias("new"), "w", "wt", "wo")
        moved = lines.join(new, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).withColumn("new_base", (F.col("wo") - F.col("new") * F.col("wt")) / F.col("w"))
        change = F.abs(F.col("new") - F.coalesce("slope", F.lit(math.inf))) + F.abs(F.col("new_base") - F.coalesce("base", F.lit(0.0)))
        lines = steps.put("lines", moved.select(*keys, "t0", "o0", "n", F.col("new").alias("slope"), F.col("new_base").alias("base"), (change > close).alias("moved")))
        if lines.where("moved").isEmpty():
            break
    return lines.select(*keys, "slope", (F.col("base") + F.col("o0") - F.col("slope") * F.col("t0")).alias("intercept"), "n")


def detect_rows(points: DataFrame, tile: str, *, bin_size: float, apart: int, least: int, reach: float, delta: float, gate: float, rounds: int = 25) -> DataFrame:
    """(tile, peak, angle, x0, y0, x1, y1, n, refused): a line per row of plants from its 1st to its 99th hundredth; refused: its angle is over ``gate`` degrees off its tile's."""
    steps = Steps(points.sparkSession)
    angles = steps.put("angles", dominant_angles(points, tile, bin_size=bin_size))
    placed = turned(points.select(tile, "x", "y"), angles, tile).where("t IS NOT NULL")
    profile = placed.groupBy(tile, F.floor(F.col("o") / bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = steps.put("found", peaks(profile, [tile], apart=apart, least=least))
    banded = steps.put("banded", near_peaks(placed, found, tile, bin_size=bin_size, reach=reach).select(tile, "peak", "t", "o"))
    lines = fit_lines(banded, [tile, "peak"], delta=delta, rounds=rounds)
    ends = banded.groupBy(tile, "peak").agg(F.percentile("t", F.array(F.lit(0.01), F.lit(0.99))).alias("ends"))
    out = lines.join(ends, [tile, "peak"]).join(angles, tile)
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))

    def at(k: int) -> tuple[Column, Column]:
        t = F.col("ends")[k]
        o = F.col("slope") * t + F.col("intercept")
        return t * c - o * s, t * s + o * c

    (x0, y0), (x1, y1) = at(0), at(1)
    lean = F.degrees(F.atan("slope"))
    return out.select(tile, "peak", F.pmod(F.col("angle") + lean, F.lit(180.0)).alias("angle"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), "n", (F.abs(lean) > gate).alias("refused"))


def periodogram(profile: DataFrame, keys: Sequence[str], at: str, value: str, periods: Sequence[float]) -> DataFrame:
    """(keys, period, power): squared length of the sum of the values' departures from their mean, turned by their place; summed map-side."""
    mean = profile.groupBy(*keys).agg(F.avg(value).alias("mean_")).select(*(F.col(k).alias(f"{k}_") for k in keys), "mean_")
    off = profile.join(mean, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    each = off.select(*keys, F.col(at).alias("at_"), (F.col(value) - F.col("mean_")).alias("v_"), F.explode(F.array(*(F.lit(float(p)) for p in periods))).alias("period"))
    turn = F.lit(2 * math.pi) * F.col("at_") / F.col("period")
    sums = each.groupBy(*keys, "period").agg(F.sum(F.col("v_") * F.cos(turn)).alias("c_"), F.sum(F.col("v_") * F.sin(turn)).alias("s_"))
    return sums.select(*keys, "period", (F.col("c_") * F.col("c_") + F.col("s_") * F.col("s_")).alias("power"))


def spectral_snr(power: DataFrame, keys: Sequence[str], spacing: float, *, wide: float) -> DataFrame:
    """(keys, snr, harmonic): mean power of frequencies within a share ``wide`` of that of the spacing over the median of all; harmonic: that of twice the spacing is greater."""
    near = lambda s: F.avg(F.when(F.abs(1 / F.col("period") - 1 / s) <= wide / s, F.col("power")))
    per = power.groupBy(*keys).agg(near(spacing).alias("peak"), near(2 * spacing).alias("sub"), F.median("power").alias("floor"))
    return per.select(*keys, F.when(F.col("floor") > 0, F.coalesce("peak", F.lit(0.0)) / F.col("floor")).otherwise(0.0).alias("snr"), (F.coalesce("sub", F.lit(0.0)) > F.coalesce("peak", F.lit(0.0))).alias("harmonic"))


def phases(points: DataFrame, keys: Sequence[str], at: str, pitch: float) -> DataFrame:
    """(keys, phase): where on a lattice of this pitch the points of a group gather, by the mean direction of their places."""
    turn = F.lit(2 * math.pi / pitch) * F.col(at)
    sums = points.groupBy(*keys).agg(F.sum(F.cos(turn)).alias("c_"), F.sum(F.sin(turn)).alias("s_"))
    return sums.select(*keys, F.pmod(F.atan2("s_", "c_") * (pitch / (2 * math.pi)), F.lit(pitch)).alias("phase"))


def is_periodic(at: Column, phase: Column, pitch: float, tol: float) -> Column:
    """If a place lies within ``tol`` pitches of a place of the lattice."""
    return F.abs(F.pmod(at - phase + pitch / 2, F.lit(pitch)) - pitch / 2) <= tol * pitch
