"""Objects cut by a tile's edge: pairs of boxes on both sides, taken one to one, and running numbers of objects.

Boxes count from their tile's corner. Two boxes are candidates if both touch the
edge their tiles share and their common length along it is at least ``least`` of
the shorter one's; candidates meet by edge and bins of the edge. They are taken
by falling share, ties to the first box in order of (row, column, y0, x0, x1, y1,
key), in rounds of joins: all that are first at both ends. Boxes without a tile
or corner pair with none; boxes of one place and key are one and share a name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.functions.text import padded
from fieldlark.operators.spatial import interval_join
from fieldlark.session import Steps


def _place(row: str, col: str, key: str, p: str = "") -> Column:
    names = {"row": row, "col": col, "y0": "y0", "x0": "x0", "x1": "x1", "y1": "y1", "key": key}
    return F.struct(*(F.col(f"{p}{c}").alias(n) for n, c in names.items()))


def edge_candidates(boxes: DataFrame, row: str, col: str, key: str, side: float, *, tol: float, least: float, bins: int = 64) -> DataFrame:
    """(first, then, share): boxes on both sides of an edge, the first being the western or northern one, as places in order."""
    b = boxes.select(row, col, key, "x0", "y0", "x1", "y1").withColumn("at", _place(row, col, key))

    def sides(touch: Column, r: Column, c: Column, low: str, high: str, kind: str) -> DataFrame:
        return b.where(touch).select("at", r.alias("r"), c.alias("c"), F.lit(kind).alias("kind"), F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high"))

    r, c = F.col(row), F.col(col)
    out = sides(F.col("x1") >= side - tol, r, c + 1, "y0", "y1", "east").unionByName(sides(F.col("y1") >= side - tol, r + 1, c, "x0", "x1", "south"))
    into = sides(F.col("x0") <= tol, r, c, "y0", "y1", "east").unionByName(sides(F.col("y0") <= tol, r, c, "x0", "x1", "south"))
    met = interval_join(out, into, ("low", "high"), bin_size=side / bins, keys=["r", "c", "kind"])
    share = (F.least("l_high", "r_high") - F.greatest("l_low", "r_low")) / F.least(F.col("l_high") - F.col("l_low"), F.col("r_high") - F.col("r_low"))
    return met.where(share >= least).select(F.col("l_at").alias("first"), F.col("r_at").alias("then"), share.alias("share"))


def greedy_pairs(links: DataFrame) -> DataFrame:
    """links (first, then, share) taken by falling share, ties by first and then, each node at most once."""
    steps, taken = Steps(links.sparkSession), []
    rest = steps.put("rest", links.select("first", "then", "share").dropDuplicates(["first", "then"]))
    order = F.struct((-F.col("share")).alias("s"), "first", "then").alias("link")
    while not rest.isEmpty():
        best = rest.select(order, F.explode(F.array("first", "then")).alias("node")).groupBy("node").agg(F.min("link").alias("link"))
        both = best.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("link.first", "link.then", (-F.col("link.s")).alias("share"))
        taken.append(steps.put(f"taken{len(taken)}", both))
        gone = taken[-1].select(F.explode(F.array("first", "then")).alias("node"))
        rest = steps.put("rest", rest.join(gone.withColumnRenamed("node", "first"), "first", "left_anti").join(gone.withColumnRenamed("node", "then"), "then", "left_anti").select("first", "then", "share"))
    return functools.reduce(DataFrame.union, taken, rest)


def object_names(boxes: DataFrame, row: str, col: str, key: str, side: float, prefix: str, *, tol: float, least: float = 0.5, digits: int = 4) -> DataFrame:
    """boxes with ``object_name``: prefix and running number in order of places; the two halves of a pair share one, with a and b.

    Numbers come from counts per row of tiles, then per tile, so no task sorts all boxes.
    """
    pairs = greedy_pairs(edge_candidates(boxes, row, col, key, side, tol=tol, least=least))
    second = pairs.select(F.col("then").alias("at_"), F.col("first").alias("lead_"))
    halves = second.unionByName(pairs.select(F.col("first").alias("at_"), F.col("first").alias("lead_")))
    placed = boxes.withColumn("at_", _place(row, col, key)).join(halves, "at_", "left")
    leads = boxes.select(_place(row, col, key).alias("at_")).distinct().join(second.select("at_"), "at_", "left_anti")
    tile = leads.groupBy(F.col("at_.row").alias("r_"), F.col("at_.col").alias("c_")).agg(F.count(F.lit(1)).alias("n_"))
    rows = tile.groupBy("r_").agg(F.sum("n_").alias("m_"))
    row_base = rows.select("r_", (F.sum("m_").over(Window.orderBy("r_")) - F.col("m_")).alias("a_"))  # a row per row of tiles
    base = tile.join(row_base.withColumnRenamed("r_", "q_"), F.col("r_").eqNullSafe(F.col("q_"))).select("r_", "c_", (F.col("a_") + F.sum("n_").over(Window.partitionBy("r_").orderBy("c_")) - F.col("n_")).alias("base_"))
    inside = leads.withColumn("i_", F.row_number().over(Window.partitionBy("at_.row", "at_.col").orderBy("at_")))
    number = inside.join(base, F.col("at_.row").eqNullSafe(F.col("r_")) & F.col("at_.col").eqNullSafe(F.col("c_"))).select(F.col("at_").alias("of_"), (F.col("base_") + F.col("i_")).alias("k_"))
    half = F.when(F.col("lead_").isNull(), "").when(F.col("lead_") == F.col("at_"), "a").otherwise("b")
    named = placed.join(number, F.coalesce("lead_", "at_").eqNullSafe(F.col("of_")))
    return named.select(*boxes.columns, F.concat(F.lit(prefix), padded(F.col("k_"), digits), half).alias("object_name"))
