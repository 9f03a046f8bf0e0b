"""Small reports and rules on objects of a survey: tiles, routes, targets, waste, boxes of objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.functions.numbers import axial_difference, box_area, box_intersection, f1_from_counts, mean_axial_deg, round_up
from fieldlark.functions.text import natural_key, padded
from fieldlark.operators.graph import components
from fieldlark.operators.spatial import box_join

_BOX = ("x0", "y0", "x1", "y1")

# --- tiles, routes, targets --------------------------------------------------------------------------------


def tile_stats(tiles: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Per grid place: mean of each value over its tiles (nulls aside), and tiles."""
    return tiles.groupBy(row, col).agg(F.count(F.lit(1)).alias("tiles"), *(round_up(F.avg(v), 4).alias(v) for v in values))


def tiles_summary(tiles: DataFrame, status: str, kinds: Sequence[str]) -> DataFrame:
    """One row: tiles in all and of each status, other statuses together."""
    s = F.col(status)
    return tiles.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(s == k).alias(f"n_{k}") for k in kinds), F.count_if(s.isNull() | ~s.isin(*kinds)).alias("n_other"))


def route_summary(routes: DataFrame, key: str, planned: str, driven: str, targets: str) -> DataFrame:
    """(key, length, source, targets): the driven length where there is one, else the planned one."""
    return routes.select(key, F.coalesce(driven, planned, F.lit(0)).alias("length"), F.when(F.col(driven).isNotNull(), "driven").when(F.col(planned).isNotNull(), "planned").otherwise("none").alias("source"), F.coalesce(targets, F.lit(0)).alias("targets"))


def ordered_targets(targets: DataFrame, group: str, position: str, name: str) -> DataFrame:
    """Targets of a group numbered: those with a place on the route by it, the rest behind by natural name."""
    order = Window.partitionBy(group).orderBy(F.col(position).asc_nulls_last(), natural_key(F.col(name)), name)
    return targets.withColumn("seq", F.row_number().over(order))


def hard_reject(checks: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first gate that fails, in the given order; null if all hold (a null gate doesn't fail)."""
    return F.coalesce(*(F.when(failed, name) for name, failed in checks))


def decimals_for(step: Column) -> Column:
    """Decimals of a power-of-ten step of at most one: 0.01 has 2; null for anything else."""
    k = F.rint(-F.log10(step))
    return F.when((step > 0) & (step <= 1) & (F.abs(step * F.pow(F.lit(10.0), k) - 1) < 1e-9), k.cast("int"))


def axial_median(df: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """(keys, median_deg): lower median of the signed differences from the axial mean, turned back to [0, 180)."""
    mean = df.groupBy(*keys).agg(mean_axial_deg(F.col(angle)).alias("mean_deg"))
    off = df.join(mean, list(keys)).withColumn("off_", axial_difference(F.col(angle), F.col("mean_deg")))
    return off.groupBy(*keys, "mean_deg").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY off_)").alias("middle_")).select(*keys, F.pmod(F.col("mean_deg") + F.col("middle_"), F.lit(180.0)).alias("median_deg"))


# --- boxes of objects --------------------------------------------------------------------------------------


def overlap_issues(inner: DataFrame, outer: DataFrame, tile: str, key: str, *, cell: float, limit: float) -> DataFrame:
    """(tile, key, overlap) of inner boxes that outer boxes of their tile cover by more than ``limit`` in sum."""
    pairs = box_join(inner.select(tile, key, *_BOX), outer.select(tile, *_BOX), cell=cell, keys=[tile])
    area = box_intersection([F.col(f"l_{c}") for c in _BOX], [F.col(f"r_{c}") for c in _BOX])
    return pairs.groupBy(F.col(f"l_{tile}").alias(tile), F.col(f"l_{key}").alias(key)).agg(F.sum(area).alias("overlap")).where(F.col("overlap") > limit)


def unknown_blocks(objects: DataFrame, blocks: DataFrame, key: str, block: str) -> DataFrame:
    """Objects that name a block that isn't there; blank names are no issue."""
    named = objects.where(F.trim(F.coalesce(F.col(block).cast("string"), F.lit(""))) != "")
    return named.join(blocks.select(block).distinct(), block, "left_anti").select(key, block)


def close_blocks(blocks: DataFrame, key: str, *, cell: float, gap: float, passages: DataFrame | None = None) -> DataFrame:
    """(a, b) of blocks nearer than ``gap`` by their boxes, but for those with a passage box between both."""
    b = blocks.select(key, *_BOX)
    if passages is not None:  # each block brings its passages along: pairs are not met again by passage
        meets = box_join(b, passages.select("passage", *_BOX), cell=cell, grow=gap).groupBy(F.col(f"l_{key}").alias("k_")).agg(F.collect_set("r_passage").alias("ps"))
        b = b.join(meets, F.col(key) == F.col("k_"), "left").drop("k_")
    pairs = box_join(b, b, cell=cell, grow=gap).where(F.col(f"l_{key}") < F.col(f"r_{key}"))
    dx = F.greatest(F.lit(0.0), F.greatest("l_x0", "r_x0") - F.least("l_x1", "r_x1"))
    dy = F.greatest(F.lit(0.0), F.greatest("l_y0", "r_y0") - F.least("l_y1", "r_y1"))
    near = pairs.where(dx * dx + dy * dy < gap * gap)
    if passages is not None:
        near = near.where(~F.coalesce(F.arrays_overlap("l_ps", "r_ps"), F.lit(False)))
    return near.select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"))


def pieces_across_tiles(boxes: DataFrame, row: str, col: str, key: str, side: float, *, tol: float) -> DataFrame:
    """(key, object_id): boxes that touch a tile's edge and overlap a box on the other side of it are one object; objects are numbered by least key.

    Box coordinates count from the tile's corner; ``side`` is a tile's length.
    """
    b = boxes.select(row, col, key, *_BOX)
    right = b.where(F.col("x1") >= side - tol).select(F.col(key).alias("a"), F.col(row).alias("r"), (F.col(col) + 1).alias("c"), F.col("y0").alias("low"), F.col("y1").alias("high"))
    left = b.where(F.col("x0") <= tol).select(F.col(key).alias("b"), F.col(row).alias("r"), F.col(col).alias("c"), F.col("y0").alias("low2"), F.col("y1").alias("high2"))
    down = b.where(F.col("y1") >= side - tol).select(F.col(key).alias("a"), (F.col(row) + 1).alias("r"), F.col(col).alias("c"), F.col("x0").alias("low"), F.col("x1").alias("high"))
    up = b.where(F.col("y0") <= tol).select(F.col(key).alias("b"), F.col(row).alias("r"), F.col(col).alias("c"), F.col("x0").alias("low2"), F.col("x1").alias("high2"))
    meet = (F.col("low") < F.col("high2")) & (F.col("low2") < F.col("high"))
    links = right.join(left, ["r", "c"]).where(meet).select("a", "b").union(down.join(up, ["r", "c"]).where(meet).select("a", "b"))
    return components(links, b.select(F.col(key).alias("node"))).select(F.col("node").alias(key), F.col("component").alias("object_id"))


def numbered_objects(objects: DataFrame, prefix: str) -> DataFrame:
    """object_id as prefix and running number, in order of the first piece; ranges of ids are counted first, so no task sorts all."""
    firsts = objects.select("object_id").distinct()
    wide = F.floor(F.col("object_id") / 4096)
    per = firsts.groupBy(wide.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = per.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row per 4,096 ids
    number = F.row_number().over(Window.partitionBy("range").orderBy("object_id")) + F.col("before")
    named = firsts.withColumn("range", wide).join(before, "range").select("object_id", F.concat(F.lit(prefix), padded(number, 4)).alias("name"))
    return objects.join(named, "object_id")


def box_scores(pred: DataFrame, ref: DataFrame, tile: str, key: str, *, cell: float, least: float, w_area: float, w_match: float) -> DataFrame:
    """Per tile: objects on both sides, matched ones, area IoU, F1 and their weighted mean.

    A pair matches if each is the other's best by IoU (ties to the least key) at
    ``least`` or more. Areas of one side don't overlap each other. A tile empty
    on both sides scores 1.
    """
    pairs = box_join(pred.select(tile, key, *_BOX), ref.select(tile, key, *_BOX), cell=cell, keys=[tile])
    a, b = [F.col(f"l_{c}") for c in _BOX], [F.col(f"r_{c}") for c in _BOX]
    pairs = pairs.select(F.col(f"l_{tile}").alias(tile), F.col(f"l_{key}").alias("p"), F.col(f"r_{key}").alias("q"), box_intersection(a, b).alias("i"), (box_area(a) + box_area(b)).alias("both")).where("i > 0")
    pairs = pairs.withColumn("iou", F.col("i") / (F.col("both") - F.col("i")))
    best = lambda side, other: F.row_number().over(Window.partitionBy(tile, side).orderBy(F.col("iou").desc(), other))
    pairs = pairs.withColumn("of_p", best("p", "q")).withColumn("of_q", best("q", "p"))
    met = pairs.groupBy(tile).agg(F.sum("i").alias("common"), F.count_if((F.col("of_p") == 1) & (F.col("of_q") == 1) & (F.col("iou") >= least)).alias("tp"))
    side = lambda df, n, s: df.groupBy(tile).agg(F.count(F.lit(1)).alias(n), F.sum(box_area([F.col(c) for c in _BOX])).alias(s))
    j = side(pred, "n_pred", "a_pred").join(side(ref, "n_ref", "a_ref"), tile, "full_outer").join(met, tile, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_pred", "n_ref", "tp", "common", "a_pred", "a_ref")}
    union = zero["a_pred"] + zero["a_ref"] - zero["common"]
    iou = F.when(union > 0, zero["common"] / union).otherwise(1.0)
    f1 = f1_from_counts(zero["tp"], zero["n_pred"], zero["n_ref"])
    return j.select(tile, zero["n_pred"].alias("n_pred"), zero["n_ref"].alias("n_ref"), zero["tp"].alias("tp"), round_up(iou, 6).alias("iou"), round_up(f1, 6).alias("f1"), round_up(w_area * iou + w_match * f1, 6).alias("score"))


def false_area_penalty(pred: DataFrame, empty: DataFrame, tile: str, *, tile_area: float, factor: float) -> DataFrame:
    """(tile, penalty): factor times the covered share of each tile that should be empty, at most 1."""
    cover = pred.groupBy(tile).agg(F.sum(box_area([F.col(c) for c in _BOX])).alias("area_"))
    return empty.select(tile).join(cover, tile, "left").select(tile, F.least(F.lit(1.0), round_up(factor * F.coalesce("area_", F.lit(0.0)) / tile_area, 6)).alias("penalty"))


def upload_issues(expected: DataFrame, found: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, issue): files that are missing, not expected, repeated or of another digest."""
    f = found.groupBy(name).agg(F.count(F.lit(1)).alias("times"), F.min(digest).alias("low"), F.max(digest).alias("high"))
    j = expected.select(name, F.col(digest).alias("want"), F.lit(True).alias("here")).join(f, name, "full_outer")
    issue = F.when(F.col("here").isNull(), "not_expected").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "repeated").when((F.col("low") != F.col("want")) | (F.col("high") != F.col("want")), "other_digest")
    return j.select(name, issue.alias("issue")).where("issue is not null")


def lanes(rows: DataFrame, block: str, row: str, position: str) -> DataFrame:
    """(block, left, right, middle, width): lanes between neighbouring rows of a block."""
    w = Window.partitionBy(block).orderBy(position, row)
    return rows.select(block, F.col(row).alias("left"), F.lead(row).over(w).alias("right"), ((F.col(position) + F.lead(position).over(w)) / 2).alias("middle"), (F.lead(position).over(w) - F.col(position)).alias("width")).where("right is not null")


def sweep_length(lane_rows: DataFrame, block: str, order: str, start: str, stop: str) -> DataFrame:
    """(block, lanes, length): lanes driven one after the other, every second one backwards, with the way from end to end."""
    w = Window.partitionBy(block).orderBy(order)
    turn = F.row_number().over(w) % 2 == 1
    ends = lane_rows.select(block, order, F.when(turn, F.col(start)).otherwise(F.col(stop)).alias("enter"), F.when(turn, F.col(stop)).otherwise(F.col(start)).alias("leave"))
    way = F.abs(F.col("leave") - F.col("enter")) + F.coalesce(F.abs(F.col("enter") - F.lag("leave").over(w)) + F.abs(F.col(order) - F.lag(order).over(w)), F.lit(0))
    return ends.withColumn("way_", way).groupBy(block).agg(F.count(F.lit(1)).alias("lanes"), F.sum("way_").alias("length"))


def zonal_share(pixels: DataFrame, zones: DataFrame, tile: str, zone: str, at: tuple[str, str], value: str, *, cell: float) -> DataFrame:
    """(tile, zone, pixels, share): set pixels of each box zone of their tile, pixel centres inside [x0, x1) x [y0, y1)."""
    x, y = at
    points = pixels.select(F.col(tile).alias("t_"), F.col(x).alias("px"), F.col(y).alias("py"), F.col(value).alias("v"), F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy"))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    z = zones.select(tile, zone, *_BOX).withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))
    hit = z.join(points, (F.col(tile) == F.col("t_")) & (z.cx == points.cx) & (z.cy == points.cy) & (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1")))
    return hit.groupBy(tile, zone).agg(F.count(F.lit(1)).alias("pixels"), round_up(F.avg(F.col("v").cast("double")), 6).alias("share"))
