"""Blocks of a survey from their objects: one row per block, parts of its outline, issues.

Objects without a block (null or blank) belong to none. Areas of one layer's
objects don't overlap each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.operators.graph import components
from fieldlark.operators.spatial import box_join

_BOX = ("x0", "y0", "x1", "y1")


def _gap2(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    dx = F.greatest(F.lit(0.0), F.greatest(f"{a}x0", f"{b}x0") - F.least(f"{a}x1", f"{b}x1"))
    dy = F.greatest(F.lit(0.0), F.greatest(f"{a}y0", f"{b}y0") - F.least(f"{a}y1", f"{b}y1"))
    return dx * dx + dy * dy


def outline_parts(objects: DataFrame, block: str, key: str, *, cell: float, reach: float) -> DataFrame:
    """(block, part, n, x0, y0, x1, y1): parts that a closing by reach / 2 makes of a block's object boxes.

    Boxes of a block at most ``reach`` apart are one part; a part is named by its least key.
    """
    o = objects.where(F.trim(F.coalesce(F.col(block).cast("string"), F.lit(""))) != "").select(block, key, *_BOX)
    firsts = o.dropna(subset=_BOX).groupBy(block, *_BOX).agg(F.min(key).alias(key))  # boxes of one place hang on their least, and only those are paired
    stars = o.join(firsts.withColumnRenamed(key, "first_"), [block, *_BOX]).where(F.col(key) != F.col("first_")).select(F.col("first_").alias("a"), F.col(key).alias("b"))
    pairs = box_join(firsts, firsts, cell=cell, keys=[block], grow=reach).where((F.col(f"l_{key}") < F.col(f"r_{key}")) & (_gap2("l_", "r_") <= reach * reach))
    part = components(pairs.select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b")).unionAll(stars), o.select(F.col(key).alias("node")))
    named = o.join(part.select(F.col("node").alias(key), F.col("component").alias("part")), key)
    return named.groupBy(block, "part").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def block_table(canopies: DataFrame, pieces: DataFrame, interrows: DataFrame, rows: DataFrame, block: str, tile: str) -> DataFrame:
    """One row per block that a canopy, row piece or lane names: counts, tiles, lengths, areas, rows and their median spacing.

    canopies, interrows: block, tile, area; pieces: block, tile, length; rows:
    block, position. Blocks with fewer than two rows have no spacing.
    """
    zero = F.lit(0).cast("double")
    layer = lambda df, kind, area, length: df.select(F.col(block).alias(block), F.col(tile).alias(tile), F.lit(kind).alias("kind"), area.cast("double").alias("area"), length.cast("double").alias("length"))
    every = layer(canopies, "canopy", F.col("area"), zero).union(layer(pieces, "piece", zero, F.col("length"))).union(layer(interrows, "interrow", F.col("area"), zero))
    every = every.where(F.trim(F.coalesce(F.col(block).cast("string"), F.lit(""))) != "")
    of = lambda kind: F.col("kind") == kind
    per = every.groupBy(block).agg(
        F.count_if(of("piece")).alias("n_row_pieces"),
        F.count_if(of("canopy")).alias("n_canopies"),
        F.count_distinct(tile).alias("n_tiles"),
        F.sum("length").alias("row_length"),
        F.sum(F.when(of("canopy"), F.col("area")).otherwise(zero)).alias("canopy_area"),
        F.sum(F.when(of("interrow"), F.col("area")).otherwise(zero)).alias("interrow_area"),
    )
    step = F.lead("position").over(Window.partitionBy(block).orderBy("position")) - F.col("position")
    spaced = rows.select(block, step.alias("step")).groupBy(block).agg(F.count(F.lit(1)).alias("n_rows"), F.median("step").alias("spacing_med"))
    return per.join(spaced, block, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def gardens(blocks: DataFrame, parts: DataFrame, forbidden: DataFrame, block: str, *, cell: float, near: float, most_rows: int) -> DataFrame:
    """Blocks with is_garden: at most ``most_rows`` rows and a part within ``near`` of a forbidden box."""
    met = box_join(parts.select(block, *_BOX), forbidden.select(*_BOX), cell=cell, grow=near).where(_gap2("l_", "r_") <= near * near)
    close = met.select(F.col(f"l_{block}").alias(block)).distinct().withColumn("close_", F.lit(True))
    return blocks.join(close, block, "left").withColumn("is_garden", F.col("close_").isNotNull() & (F.col("n_rows") <= most_rows)).drop("close_")


def block_issues(blocks: DataFrame, parts: DataFrame, block: str, *, least_rows: int) -> DataFrame:
    """(block, code, detail): outlines in several parts, and blocks of too few rows."""
    split = parts.groupBy(block).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select(block, F.lit("block_split").alias("code"), F.col("n_").cast("int").alias("detail"))
    few = blocks.where(F.col("n_rows") < least_rows).select(block, F.lit("block_too_few_rows").alias("code"), F.col("n_rows").cast("int").alias("detail"))
    return split.union(few)


def span_matches(pred: DataFrame, ref: DataFrame, group: str, key: str, *, tol: float, least: float) -> DataFrame:
    """(group, p, q, cover): rows of both sides that are each other's best by mutual cover.

    A row is a span [x0, x1] at ``position``; a pair covers if the positions are
    within ``tol``, by the smaller of the shares of either span in the other,
    at ``least`` or more. Ties go to the least key. Spans of one side and place
    don't overlap, so for least > 0.5 rivals can only lie at other positions.
    Of equal spans of one side only the one with the least key can be a best.
    """
    firsts = lambda df: df.where("x0 < x1").groupBy(group, "position", "x0", "x1").agg(F.min(key).alias(key))
    side = lambda df, p: firsts(df).select(F.col(group).alias(f"{p}group"), F.col(key).alias(f"{p}key"), F.col("position").alias(f"{p}at"), F.col("x0").alias(f"{p}x0"), F.col("x1").alias(f"{p}x1"))
    width = tol if tol > 0 else 1.0
    cell = F.floor(F.col("l_at") / width)
    left = side(pred, "l_").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    right = side(ref, "r_").withColumn("cell_", F.floor(F.col("r_at") / width))
    common = F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")
    cover = common / F.greatest(F.col("l_x1") - F.col("l_x0"), F.col("r_x1") - F.col("r_x0"))
    pairs = left.join(right, (F.col("l_group") == F.col("r_group")) & (F.col("cell") == F.col("cell_")) & (F.abs(F.col("l_at") - F.col("r_at")) <= tol) & (cover >= least))
    pairs = pairs.select(F.col("l_group").alias(group), F.col("l_key").alias("p"), F.col("r_key").alias("q"), cover.alias("cover"))
    best = lambda mine, other: F.row_number().over(Window.partitionBy(group, mine).orderBy(F.col("cover").desc(), other))
    return pairs.withColumn("of_p", best("p", "q")).withColumn("of_q", best("q", "p")).where("of_p = 1 and of_q = 1").drop("of_p", "of_q")
