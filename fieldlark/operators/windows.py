"""Order-dependent operators: ranks, neighbours, runs, intervals, numbering.

All are Window or array expressions. Every order ends in a unique key, so
results do not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.functions.text import padded


def ordered_neighbours(rows: DataFrame, block: str, position: str, row: str, *, grain: float = 1e-3) -> DataFrame:
    """Rank in the block by falling position (in steps of ``grain``), then id; spacing to both neighbours."""
    at = F.floor(F.col(position) / grain + 0.5)
    w = Window.partitionBy(block).orderBy(at.desc(), row)
    return rows.select(
        "*",
        F.row_number().over(w).alias("row_index"),
        (F.lag(position).over(w) - F.col(position)).alias("spacing_prev"),
        (F.col(position) - F.lead(position).over(w)).alias("spacing_next"),
    )


def consecutive_pairs(rows: DataFrame, block: str, order: Sequence[str | Column], row: str) -> DataFrame:
    """(block, row_a, row_b) of neighbours in order."""
    w = Window.partitionBy(block).orderBy(*order)
    return rows.select(block, F.col(row).alias("row_a"), F.lead(row).over(w).alias("row_b")).where(F.col("row_b").isNotNull())


def running_numbers(pairs: DataFrame, block: str, i: str, j: str) -> DataFrame:
    """k = max(previous k + 1, min(i, j)) over pairs in order of (min, max), as a closed form: rank + running max(min - rank)."""
    low, high = F.least(i, j), F.greatest(i, j)
    w = Window.partitionBy(block).orderBy(low, high)
    ranked = pairs.withColumn("rank_", F.row_number().over(w)).withColumn("low_", low)
    run = Window.partitionBy(block).orderBy("rank_").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("k", (F.col("rank_") + F.max(F.col("low_") - F.col("rank_")).over(run)).cast("int")).drop("rank_", "low_")


def runs_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, start: str, stop: str) -> DataFrame:
    """Maximal runs of equal state: (keys, state, run_start, run_stop, n)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turn = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("turn_", turn).withColumn("run_", F.sum("turn_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run_", state).agg(F.min(start).alias("run_start"), F.max(stop).alias("run_stop"), F.count(F.lit(1)).alias("n")).drop("run_")


def gaps(points: DataFrame, keys: Sequence[str], at: str, *, least: float, unique: str) -> DataFrame:
    """Empty stretches of at least ``least`` between neighbouring points: (keys, gap_start, gap_stop, gap)."""
    w = Window.partitionBy(*keys).orderBy(at, unique)
    before = points.select(*keys, F.lag(at).over(w).alias("gap_start"), F.col(at).alias("gap_stop"))
    return before.withColumn("gap", F.col("gap_stop") - F.col("gap_start")).where(F.col("gap") >= least)


def gap_kinds(found: DataFrame, start: str, stop: str, length: str) -> DataFrame:
    """head, tail, interior or full."""
    head, tail = F.col(start) <= 0, F.col(stop) >= F.col(length)
    return found.withColumn("kind", F.when(head & tail, "full").when(head, "head").when(tail, "tail").otherwise("interior"))


def merge_intervals(spans: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    """Union of touching or overlapping intervals."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(*keys, start, stop, F.when(F.col(start) <= reach, 0).otherwise(1).alias("new_"))
    islands = marked.withColumn("island_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island_").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("island_")


def holes(spans: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    """Stretches between the first start and the last stop that no interval covers."""
    merged = merge_intervals(spans, keys, start, stop)
    w = Window.partitionBy(*keys).orderBy(start)
    return merged.select(*keys, F.col(stop).alias("hole_start"), F.lead(start).over(w).alias("hole_stop")).where(F.col("hole_stop").isNotNull())


def subtract_intervals(spans: DataFrame, cuts: DataFrame, keys: Sequence[str], unique: str, start: str, stop: str) -> DataFrame:
    """Parts of spans outside cuts: (keys, unique, start, stop, censored); censored: a cut touches the part.

    The cuts of a key are merged, so the parts lie between neighbouring cuts: the
    join is by key with an overlap residual and each part comes from one lag.
    """
    merged = merge_intervals(cuts, keys, start, stop).select(*(F.col(k).alias(f"cut_{k}") for k in keys), F.col(start).alias("cut_start"), F.col(stop).alias("cut_stop"))
    same = [F.col(k) == F.col(f"cut_{k}") for k in keys]
    near = (F.col("cut_start") < F.col(stop)) & (F.col("cut_stop") > F.col(start))
    condition = near
    for s in same:
        condition = condition & s
    hit = spans.select(*keys, unique, start, stop).join(merged, condition, "left")
    w = Window.partitionBy(*keys, unique).orderBy("cut_start")
    before = hit.select(*keys, unique, F.coalesce(F.lag("cut_stop").over(w), F.col(start)).alias("a_"), F.coalesce("cut_start", stop).alias("b_"), F.lag("cut_stop").over(w).isNotNull().alias("left_"), F.col("cut_start").isNotNull().alias("right_"))
    last = hit.where(F.col("cut_start").isNotNull()).groupBy(*keys, unique).agg(F.max("cut_stop").alias("a_"), F.max(stop).alias("b_")).select(*keys, unique, "a_", "b_", F.lit(True).alias("left_"), F.lit(False).alias("right_"))
    return before.unionByName(last).where("a_ < b_").select(*keys, unique, F.col("a_").alias(start), F.col("b_").alias(stop), (F.col("left_") | F.col("right_")).alias("censored"))


def moving(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, half: int, how: str = "avg") -> DataFrame:
    """Moving avg, min or max over +-half rows, as ``smooth``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("smooth", {"avg": F.avg, "min": F.min, "max": F.max}[how](value).over(w))


def close_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, half: int) -> DataFrame:
    """1-D closing of a boolean: dilation by ``half`` rows, then erosion; as ``closed``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    grown = df.withColumn("grown_", F.max(F.col(flag).cast("int")).over(w))
    return grown.withColumn("closed", F.min("grown_").over(w) == 1).drop("grown_")


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def stops(visits: DataFrame, route: str, order: Sequence[str], distance: str) -> DataFrame:
    """seq, cumulative distance and leg of each stop; a stop at the same place has leg 0."""
    w = Window.partitionBy(route).orderBy(*order)
    return visits.select("*", F.row_number().over(w).alias("seq"), F.col(distance).alias("cum_dist"), (F.col(distance) - F.coalesce(F.lag(distance).over(w), F.lit(0))).alias("leg"))


def sparse_windows(points: DataFrame, lengths: DataFrame, key: str, at: str, length: str, *, window: int, step: int, least: int) -> DataFrame:
    """Sliding windows along each key with fewer than ``least`` points, overlapping ones merged.

    lengths: (key, length). A point goes to the windows it is in (window / step of them), so nothing is joined by range.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), (F.col(length) - window).cast("long")), F.lit(step).cast("long"))
    every = lengths.select(key, F.explode(starts).alias("window_start"))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(at) - window) / step).cast("long") + 1)
    mine = points.select(key, F.explode(F.when(F.floor(F.col(at) / step) >= first, F.sequence(first, F.floor(F.col(at) / step).cast("long")))).alias("slot")).select(key, (F.col("slot") * step).alias("window_start"))
    counted = mine.groupBy(key, "window_start").agg(F.count(F.lit(1)).alias("n"))
    sparse = every.join(counted, [key, "window_start"], "left").where(F.coalesce("n", F.lit(0)) < least)
    return merge_intervals(sparse.withColumn("window_stop", F.col("window_start") + window), [key], "window_start", "window_stop")


def segment_samples(spans: DataFrame, start: str, stop: str, *, long: float, step: float) -> DataFrame:
    """One sub-segment, or ceil(L / step) equal ones of a span over ``long``: part, part_start, part_stop."""
    size = F.col(stop) - F.col(start)
    n = F.when(size <= long, 1).otherwise(F.ceil(size / step)).cast("int")
    cut = spans.withColumn("n_", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    at = lambda k: F.col(start) + size * k / F.col("n_")
    return cut.withColumn("part_start", at(F.col("part"))).withColumn("part_stop", at(F.col("part") + 1)).drop("n_")


def wide_spacings(rows: DataFrame, block: str, position: str, row: str, *, factor: float) -> DataFrame:
    """Neighbours further apart than ``factor`` times the block's median spacing, with the number of rows missing between."""
    w = Window.partitionBy(block).orderBy(position, row)
    spaced = rows.select(block, F.lag(row).over(w).alias("row_a"), F.col(row).alias("row_b"), (F.col(position) - F.lag(position).over(w)).alias("spacing")).where(F.col("spacing").isNotNull())
    median = spaced.groupBy(block).agg(F.percentile("spacing", 0.5).alias("median_spacing"))
    wide = spaced.join(median, block).where(F.col("spacing") > factor * F.col("median_spacing"))
    n = F.when(F.col("median_spacing") > 0, F.floor(F.col("spacing") / F.col("median_spacing") + 0.5) - 1).otherwise(1)
    return wide.withColumn("missing", F.greatest(F.lit(1), n).cast("int"))


def spacing_steps(rows: DataFrame, block: str, position: str, row: str, *, n: int, least: float) -> DataFrame:
    """Rows where the medians of the n spacings before and after differ by more than ``least``."""
    w = Window.partitionBy(block).orderBy(position, row)
    spaced = rows.withColumn("spacing", F.col(position) - F.lag(position).over(w)).where(F.col("spacing").isNotNull())
    before = F.percentile("spacing", 0.5).over(w.rowsBetween(-n + 1, 0))
    after = F.percentile("spacing", 0.5).over(w.rowsBetween(1, n))
    full = (F.count(F.lit(1)).over(w.rowsBetween(-n + 1, 0)) == n) & (F.count(F.lit(1)).over(w.rowsBetween(1, n)) == n)
    return spaced.select(block, row, before.alias("median_before"), after.alias("median_after"), full.alias("full_")).where(F.col("full_") & (F.abs(F.col("median_before") - F.col("median_after")) > least)).drop("full_")


def cluster_sorted(df: DataFrame, keys: Sequence[str], value: str, unique: str, tol: float) -> DataFrame:
    """Cluster numbers of sorted values: a step over ``tol`` begins the next."""
    w = Window.partitionBy(*keys).orderBy(value, unique)
    new = F.when(F.col(value) - F.lag(value).over(w) <= tol, 0).otherwise(1)
    return df.withColumn("new_", new).withColumn("cluster", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new_")


def numbered_by_kind(df: DataFrame, kind: str, order: Sequence[str | Column], prefix: Column, width: int = 4) -> DataFrame:
    """Ids with a running number per kind."""
    w = Window.partitionBy(kind).orderBy(*order)
    return df.withColumn("number", F.row_number().over(w)).withColumn("object_id", F.concat(prefix, padded(F.col("number"), width)))


def inside_runs(legs: DataFrame, route: str, seq: str, outside: str) -> DataFrame:
    """Maximal runs of legs without outside length: (route, first_seq, last_seq)."""
    w = Window.partitionBy(route).orderBy(seq)
    free = legs.withColumn("block_", F.sum(F.when(F.col(outside) > 0, 1).otherwise(0)).over(w)).where(F.col(outside) <= 0)
    return free.groupBy(route, "block_").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq")).drop("block_")
