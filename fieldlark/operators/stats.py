"""Exact statistics: quantiles, histograms, shares, folds, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.functions.numbers import bin_index, round_up, share
from fieldlark.functions.text import natural_key


def quantile(x: Column, q: float) -> Column:
    """Aggregate: linear-interpolated quantile, 0 for no values."""
    return F.coalesce(F.percentile(x, q), F.lit(0.0))


def histogram(df: DataFrame, value: str, edges: Sequence[float], weight: str | None = None) -> DataFrame:
    """(bin, low, high, n[, weight]) of every bin, zeros included; the last bin is open."""
    n_bins = max(1, len(edges) - 1)
    total = [F.count(F.lit(1)).alias("n")] + ([F.sum(weight).alias("total")] if weight else [])
    found = df.where(F.col(value).isNotNull()).groupBy(bin_index(F.col(value), edges).alias("bin")).agg(*total)
    rows = ", ".join(f"({k}, CAST({edges[k]} AS DOUBLE), CAST({edges[k + 1] if k + 1 < n_bins else 'NULL'} AS DOUBLE))" for k in range(n_bins))
    every = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS bins(bin, low, high)")
    out = every.join(F.broadcast(found), "bin", "left")  # a row per bin
    cols = ["bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n")] + ([F.coalesce("total", F.lit(0)).alias("total")] if weight else [])
    return out.select(*cols)


def count_by(df: DataFrame, key: str, null_key: str | None = None) -> DataFrame:
    k = F.coalesce(F.col(key), F.lit(null_key)) if null_key is not None else F.col(key)
    return (df if null_key is not None else df.where(F.col(key).isNotNull())).groupBy(k.alias(key)).agg(F.count(F.lit(1)).alias("n"))


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-blank value per key, ties to the natural-order least; '' without one."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_"))
    order = F.struct((-F.when(F.trim(F.coalesce(F.col(value), F.lit(""))) == "", 0).otherwise(F.col("n_"))).alias("n"), natural_key(F.col(value)).alias("k"))
    found = counted.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col("n_").alias("n")), order).alias("best_"))
    return found.select(*keys, F.when(F.trim(F.coalesce("best_.v", F.lit(""))) == "", "").otherwise(F.col("best_.v")).alias("majority"))


def majority_by_length(df: DataFrame, keys: Sequence[str], value: str, length: str) -> DataFrame:
    """Most frequent value, ties to the larger total length, then the natural-order least."""
    counted = df.where(F.trim(value) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_"), F.sum(length).alias("l_"))
    order = F.struct((-F.col("n_")).alias("n"), (-F.col("l_")).alias("l"), natural_key(F.col(value)).alias("k"))
    return counted.groupBy(*keys).agg(F.min_by(value, order).alias("majority"))


def structure_fold(value: Column) -> Column:
    """Aggregate: disrupted if any is, unassessable if all are (or not known), else regular."""
    return F.when(F.bool_or(value == "disrupted"), "disrupted").when(F.bool_and(~value.isin("regular", "disrupted") | value.isNull()), "unassessable").otherwise("regular")


def structure_any(value: Column) -> Column:
    """Aggregate: the same fold, regular for nothing."""
    return F.coalesce(F.when(F.bool_or(value == "disrupted"), "disrupted").when(F.bool_and(value == "unassessable"), "unassessable"), F.lit("regular"))


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys by falling value with cumulative share of the total (value: whole numbers or decimals).

    Totals of key ranges are summed first and only those are put in one order,
    so no task sorts the whole table.
    """
    total = df.select(F.sum(value).alias("all_"), F.max(value).alias("top_"))
    spread = df.crossJoin(F.broadcast(total)).withColumn("range_", F.when(F.col("top_") > 0, F.floor((1 - F.col(value) / F.col("top_")) * 1023)).otherwise(0).cast("long"))
    sums = spread.groupBy("range_").agg(F.sum(value).alias("s_"))
    before = sums.select("range_", F.coalesce(F.sum("s_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))  # some thousand rows
    w = Window.partitionBy("range_").orderBy(F.col(value).desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    running = spread.join(F.broadcast(before), "range_").withColumn("running_", F.sum(value).over(w) + F.col("before_"))
    return running.select(key, value, share(F.col("running_").cast("double"), F.col("all_").cast("double")).alias("cum_share"))


def two_level_sums(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Sums by (outer, inner) and by outer (inner null), by rollup."""
    return df.rollup(outer, inner).agg(F.sum(value).alias("total")).where(F.col(outer).isNotNull())


def zero_filled(df: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Sum per key of the dimension, 0 where there is nothing."""
    found = df.groupBy(key).agg(F.sum(value).alias("total"))
    return dimension.select(key).distinct().join(found, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"))


def argmax_then_count(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Per key the value of its heaviest row (ties: the least value), then rows per value."""
    best = df.groupBy(key).agg(F.min_by(value, F.struct((-F.col(weight)).alias("w"), F.col(value).alias("v"))).alias("value"))
    return best.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def balanced_parts(df: DataFrame, key: str, value: str, total: Column) -> DataFrame:
    """Whole-number parts whose residual against ``total`` goes, one unit each, to the largest parts. df: a row per key, few keys."""
    one = Window.partitionBy(F.lit(1))
    ranked = df.withColumn("residual_", (total - F.sum(value).over(one)).cast("long")).withColumn("rank_", F.row_number().over(one.orderBy(F.col(value).desc(), key))).withColumn("n_", F.count(F.lit(1)).over(one))
    each = F.floor(F.col("residual_") / F.col("n_")).cast("long")
    extra = F.pmod(F.col("residual_"), F.col("n_"))
    return ranked.select(key, value, (F.col(value) + each + F.when(F.col("rank_") <= extra, 1).otherwise(0)).alias("balanced"))


def axial_rose(df: DataFrame, angle: str, length: str, bin_deg: int = 10) -> DataFrame:
    """Length per axial bin with the share of the bin and its two circular neighbours."""
    n = 180 // bin_deg
    binned = df.groupBy(F.pmod(F.floor(F.col(angle) / bin_deg), F.lit(n)).cast("int").alias("bin")).agg(F.sum(length).alias("length"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    full = every.join(F.broadcast(binned), "bin", "left").select("bin", F.coalesce("length", F.lit(0)).alias("length"))
    around = full.select(F.explode(F.array(*(F.pmod(F.col("bin") + d, F.lit(n)) for d in (-1, 0, 1)))).alias("bin"), F.col("length").alias("l_")).groupBy("bin").agg(F.sum("l_").alias("l_"))
    total = full.agg(F.sum("length").alias("t_"))
    return full.join(around, "bin").crossJoin(F.broadcast(total)).select("bin", "length", share(F.col("l_").cast("double"), F.col("t_").cast("double")).alias("near_share"))


def timing_summary(items: DataFrame, key: str, status: str, duration: str, done: str = "done") -> DataFrame:
    """Counts, sum, mean, p50, p95, max of finished items per key; zeros when none."""
    d = F.when(F.col(status) == done, F.col(duration))
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(d).alias("n_done"),
        F.coalesce(F.sum(d), F.lit(0)).alias("total"),
        round_up(F.coalesce(F.avg(d), F.lit(0.0)), 4).alias("mean"),
        round_up(quantile(d, 0.5), 4).alias("p50"),
        round_up(quantile(d, 0.95), 4).alias("p95"),
        F.coalesce(F.max(d), F.lit(0)).alias("longest"),
    )


def sums_of_distinct(df: DataFrame, key: str, part: str, value: str) -> DataFrame:
    """Sum per key, only where all its parts are different."""
    return df.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct(part).alias("n_parts")).where("n = n_parts").select(key, "total", "n")


def three_level_report(pieces: DataFrame, *, row: str, block: str, length: str, area: str, kind: str) -> DataFrame:
    """survey, block and row lines: counts and sums (length, area: whole numbers or decimals).

    A row's block is the majority of its pieces' blocks, so block lines are not
    a rollup of the pieces' own blocks. Pieces without a row are left out.
    """
    pieces = pieces.where(F.col(row).isNotNull())
    of_row = majority(pieces, [row], block).withColumnRenamed("majority", "block_id")
    rows = pieces.groupBy(row).agg(F.sum(length).alias("length"), F.sum(area).alias("area"), F.count(F.lit(1)).alias("pieces"), structure_fold(F.col(kind)).alias("structure")).join(of_row, row)
    none = F.lit(None).cast("string")
    lines = rows.select(F.lit("row").alias("level"), "block_id", F.col(row).cast("string").alias("row_id"), F.lit(1).cast("long").alias("rows"), "pieces", "length", "area", "structure")
    blocks = rows.groupBy("block_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("pieces").alias("pieces"), F.sum("length").alias("length"), F.sum("area").alias("area"))
    survey = blocks.agg(F.sum("rows").alias("rows"), F.sum("pieces").alias("pieces"), F.sum("length").alias("length"), F.sum("area").alias("area"))
    return (
        survey.select(F.lit("survey").alias("level"), none.alias("block_id"), none.alias("row_id"), "rows", "pieces", "length", "area", none.alias("structure"))
        .unionByName(blocks.select(F.lit("block").alias("level"), "block_id", none.alias("row_id"), "rows", "pieces", "length", "area", none.alias("structure")))
        .unionByName(lines)
    )
