"""Pieces between rows linked to the rows on both sides, in the frame of their block, and the spaces they make numbered.

A block's axis is a unit vector (ux, uy); along it a place has a position, across
it (to the left of the axis) an offset. A row line is an array of points, read in
order of position; before its first and after its last point it keeps their place.

Pieces meet lines by block and cells of the greatest offset (and of positions
where a line has to cover the piece), so no block is in one task. Pieces without
a place, block or axis link with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.functions.text import padded


def in_frame(lines: DataFrame, axes: DataFrame, block: str, points: str) -> DataFrame:
    """lines with ``path_``: points as (t, o) by rising position, and the extents t0_, t1_, o0_, o1_. Lines without a point go."""
    at = lambda p: F.struct((p["x"] * F.col("ux") + p["y"] * F.col("uy")).alias("t"), (p["y"] * F.col("ux") - p["x"] * F.col("uy")).alias("o"))
    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    framed = lines.withColumn(points, whole).where(F.size(points) > 0).join(axes.select(block, "ux", "uy"), block).withColumn("path_", F.array_sort(F.transform(points, at))).drop("ux", "uy")
    # a field of an array of structs is an array
    ends = {f"{c}{i}_": f(f"path_.{c}") for c in ("t", "o") for i, f in ((0, F.array_min), (1, F.array_max))}
    return framed.withColumns(ends)


def offset_at(path: Column, t: Column) -> Column:
    """Offset of a path at a position, straight between its points."""
    before = F.element_at(F.filter(path, lambda p: p["t"] <= t), -1)
    after = F.element_at(F.filter(path, lambda p: p["t"] > t), 1)
    between = before["o"] + (t - before["t"]) * (after["o"] - before["o"]) / (after["t"] - before["t"])
    return F.when((t < F.get(path, F.lit(0))["t"]), F.get(path, F.lit(0))["o"]).when(t >= F.get(path, F.size(path) - 1)["t"], F.get(path, F.size(path) - 1)["o"]).otherwise(between)


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _sides(pieces: DataFrame, lines: DataFrame, keys: list[str], piece: str, row: str, *, most: float, cover: float | None, cell: float) -> DataFrame:
    """(piece, left, right): structs (distance, row) of the nearest line within ``most`` on either side, ties to the least row."""
    here = pieces.select(*keys, F.col(piece).alias("piece_"), F.col("at_"), F.col("off_"), F.floor(F.col("off_") / most).alias("across_"))
    there = lines.select(*keys, F.col(row).alias("row_"), "path_", "t0_", "t1_", _cells(F.col("o0_") - most, F.col("o1_") + most, most).alias("across_"))
    on = [*keys, "across_"]
    if cover is not None:
        on = [*on, "along_"]
        here = here.withColumn("along_", F.floor(F.col("at_") / cell))
        there = there.withColumn("along_", _cells(F.col("t0_") - cover, F.col("t1_") + cover, cell))
    met = here.join(there, on)
    if cover is not None:
        met = met.where((F.col("at_") >= F.col("t0_") - cover) & (F.col("at_") <= F.col("t1_") + cover))
    far = met.select("piece_", "row_", (offset_at(F.col("path_"), F.col("at_")) - F.col("off_")).alias("far_")).where(F.abs("far_") <= most)
    of = lambda rule: F.min(F.when(rule, F.struct(F.abs("far_").alias("distance"), F.col("row_").alias("row"))))
    return far.groupBy("piece_").agg(of(F.col("far_") > 0).alias("left"), of(F.col("far_") < 0).alias("right"))


def link_pieces_to_lines(pieces: DataFrame, lines: DataFrame, rows: DataFrame, axes: DataFrame, *, block: str, tile: str, piece: str, row: str, points: str, most: float, cover: float, cell: float = 64.0) -> DataFrame:
    """(piece, block, left, right, left_offset, right_offset, method): the nearest rows on both sides, at most ``most`` away.

    pieces: (piece, block, tile, x, y), keys unique. lines: (row, block, tile,
    points), the parts of rows within tiles; rows: (row, block, points), whole
    rows. A side is looked for among the lines of the piece's tile; where these
    do not give both, what is missing among the block's rows that cover the
    piece's position within ``cover``. method: tile, block, or none where a side
    is still missing.
    """
    placed = pieces.join(axes.select(block, "ux", "uy"), block, "left")
    framed = placed.select(piece, block, tile, (F.col("x") * F.col("ux") + F.col("y") * F.col("uy")).alias("at_"), (F.col("y") * F.col("ux") - F.col("x") * F.col("uy")).alias("off_"))
    whole = framed.where("at_ IS NOT NULL AND off_ IS NOT NULL")
    near = _sides(whole, in_frame(lines, axes, block, points), [block, tile], piece, row, most=most, cover=None, cell=cell)
    open_ = whole.join(near.where("left IS NOT NULL AND right IS NOT NULL").select(F.col("piece_").alias(piece)), piece, "left_anti")
    wide = _sides(open_, in_frame(rows, axes, block, points), [block], piece, row, most=most, cover=cover, cell=cell)
    one = near.select("piece_", F.col("left").alias("l1"), F.col("right").alias("r1"))
    two = wide.select("piece_", F.col("left").alias("l2"), F.col("right").alias("r2"))
    found = one.join(two, "piece_", "full").withColumn("l", F.coalesce("l1", "l2")).withColumn("r", F.coalesce("r1", "r2")).withColumnRenamed("piece_", piece)
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    method = F.when(F.col("l1").isNotNull() & F.col("r1").isNotNull(), "tile").when(both, "block").otherwise("none")
    return pieces.select(piece, block).join(found, piece, "left").select(
        piece, block, F.col("l.row").alias("left"), F.col("r.row").alias("right"), F.col("l.distance").alias("left_offset"), F.col("r.distance").alias("right_offset"), method.alias("method")
    )


def numbered_spaces(linked: DataFrame, order: DataFrame, *, block: str, row: str, index: str) -> DataFrame:
    """linked with ``space``: the number of the space between its two rows; null for pieces with a side missing.

    order: (row, index), a row's number in its block. The pairs of a block, by
    lesser and greater index, bear the lesser index, or the next free number if
    that is taken: the running greatest of (lesser index - place), plus place.
    """
    at = order.select(F.col(row).alias("row_"), F.col(index).cast("long").alias("index_"))
    left, right = (at.withColumnsRenamed({"row_": s, "index_": f"{s}_index"}) for s in ("left", "right"))
    known = linked.where("left IS NOT NULL AND right IS NOT NULL").select(block, "left", "right").distinct().join(left, "left").join(right, "right")
    pairs = known.select(block, "left", "right", F.least("left_index", "right_index").alias("low"), F.greatest("left_index", "right_index").alias("high"))
    slots = pairs.select(block, "low", "high").distinct()
    w = Window.partitionBy(block).orderBy("low", "high")  # a row per pair of neighbouring rows of a block
    place = slots.withColumn("place", F.row_number().over(w))
    number = place.withColumn("space", F.col("place") + F.greatest(F.lit(0), F.max(F.col("low") - F.col("place")).over(w))).drop("place")
    return linked.join(pairs.join(number, [block, "low", "high"]).select(block, "left", "right", "space"), [block, "left", "right"], "left")


def space_name(block: Column, number: Column) -> Column:
    """Block, -I and three digits; null without a number."""
    return F.concat(block, F.lit("-I"), padded(number, 3))
