"""Blocks derived from a survey's objects: one row per block with true areas and its closed outline.

Areas are those of unions, so objects may overlap; the outline is the closing of
all objects of a block (crowns, row pieces, lanes), or what its lines cover when
grown, if they close to nothing. Objects without a block (null or blank) belong to
none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators.blocks import block_table
from fieldlark.operators.outlines import boundary, measures, outline_of, trace
from fieldlark.operators.quadtree import BOX
from fieldlark.session import Steps


def derive(canopies: DataFrame, pieces: DataFrame, interrows: DataFrame, rows: DataFrame, block: str, tile: str, *, reach: float, lone_reach: float) -> DataFrame:
    """The columns of block_table, and outline_area, outline_length, n_parts and n_holes.

    canopies, pieces, interrows: (block, tile, box); a piece is a box without
    width or height and as long as its longer side. rows: (block, position).
    """
    held = F.trim(F.coalesce(F.col(block).cast("string"), F.lit(""))) != ""
    layers = [df.where(held).select(block, tile, *BOX) for df in (canopies, pieces, interrows)]
    sides = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    none = F.lit(0.0)
    table = block_table(layers[0].withColumn("area", none), layers[1].withColumn("length", sides), layers[2].withColumn("area", none), rows.where(held), block, tile).drop("canopy_area", "interrow_area")
    area = lambda df, name: measures(boundary(df, block), block).select(block, F.col("area").alias(name))
    every = layers[0].unionByName(layers[1]).unionByName(layers[2]).select(block, *BOX)
    edges = Steps(canopies.sparkSession).put("outline", outline_of(every, block, reach=reach, lone_reach=lone_reach))
    size = measures(edges, block).select(block, F.col("area").alias("outline_area"), F.col("length").alias("outline_length"))
    parts = trace(edges, block).groupBy(block).agg(F.count_if(F.col("area") > 0).alias("n_parts"), F.count_if(F.col("area") < 0).alias("n_holes"))
    out = table.join(area(layers[0], "canopy_area"), block, "left").join(area(layers[2], "interrow_area"), block, "left").join(size, block, "left").join(parts, block, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("canopy_area", "interrow_area")})
