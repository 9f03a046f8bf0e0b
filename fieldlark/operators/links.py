"""Links between rows, pieces, targets, roads and edges: neighbour joins by cells, two-sided nearest rows, cuts, sets, edits.

Joins meet on block or tile and a cell of the searched distance, never block against block. Positions of
``link_pieces`` are whole numbers. Rows without a key or position link with nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def link_pieces(pieces: DataFrame, rows: DataFrame, *, block: str, tile: str, at: str, piece: str, row: str) -> DataFrame:
    """pieces with ``left`` and ``right``: the next row before and after, of the same tile if there is one, else of the block.

    Of rows at one position the least counts; rows at the piece's own position are on neither side.
    """

    def add(df: DataFrame, keys: list[str], level: str) -> DataFrame:
        marks = rows.groupBy(*keys, at).agg(F.min(row).alias("row_")).withColumn("mark_", F.lit(True))
        both = df.unionByName(marks, allowMissingColumns=True)
        # both sides look back over a growing frame: a frame that ends at the last row is computed anew for every row
        for side, order in (("left", F.col(at).asc()), ("right", F.col(at).desc())):
            frame = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
            both = both.withColumn(f"{side}_{level}", F.last("row_", ignorenulls=True).over(frame))
        return both.where("mark_ IS NULL").drop("row_", "mark_")

    out = add(add(pieces, [block, tile], "tile"), [block], "block")
    found = [F.coalesce(f"{s}_tile", f"{s}_block").alias(s) for s in ("left", "right")]
    return out.select(*pieces.columns, *found)


def linked_spaces(linked: DataFrame, block: str, area: str) -> DataFrame:
    """One space per pair of rows that pieces lie between: ``n_pieces`` and the sum of area."""
    return linked.where("left IS NOT NULL AND right IS NOT NULL").groupBy(block, "left", "right").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(area).alias(area))


def target_features(targets: DataFrame, stops: DataFrame, visits: DataFrame, *, key: str, group: str, seq: str) -> DataFrame:
    """targets with their first stop, number of visits, ``visited`` and place in the group (by stop, then key; without a stop last)."""
    first = stops.groupBy(key).agg(F.min(seq).alias("stop"))
    seen = visits.groupBy(key).agg(F.count(F.lit(1)).alias("n_visits"))
    out = targets.join(first, key, "left").join(seen, key, "left").withColumn("n_visits", F.coalesce("n_visits", F.lit(0)))
    place = Window.partitionBy(group).orderBy(F.col("stop").asc_nulls_last(), key)
    return out.withColumn("visited", F.col("n_visits") > 0).withColumn("place", F.row_number().over(place))


def farm_blocks(farms: DataFrame, farm: str, ids: str) -> DataFrame:
    """A row per block named in the farm's list ``ids`` (commas, blanks ignored); a block in several lists goes to the least farm."""
    each = farms.select(farm, F.explode(F.split(ids, ",")).alias("block")).withColumn("block", F.trim("block")).where("block <> ''")
    return each.groupBy("block").agg(F.min(farm).alias(farm))


def split_edges(edges: DataFrame, cuts: DataFrame, *, edge: str, length: str, at: str, merge: float) -> DataFrame:
    """edges in pieces at their cuts: ``piece`` from 1, ``start``, ``stop``, and names of both nodes.

    Cuts within merge of an end are that end; of cuts each within merge of the one before, the first stands for all.
    """
    inner = cuts.join(edges.select(edge, length), edge).where((F.col(at) > merge) & (F.col(at) < F.col(length) - merge)).select(edge, length, F.col(at).alias("start")).distinct()
    by = Window.partitionBy(edge).orderBy("start")
    before = F.lag("start").over(by)
    firsts = inner.withColumn("far_", before.isNull() | (F.col("start") - before > merge)).where("far_").drop("far_")
    begun = edges.select(edge, length, F.lit(0.0).alias("start")).unionByName(firsts)
    ends = begun.withColumn("piece", F.row_number().over(by)).withColumn("next_", F.lead("start").over(by))
    name = lambda place: F.concat_ws(":", F.col(edge), place)
    return ends.select(
        edge, "piece", "start", F.coalesce("next_", F.col(length).cast("double")).alias("stop"),
        name(F.when(F.col("piece") == 1, F.lit("a")).otherwise((F.col("piece") - 1).cast("string"))).alias("from_node"),
        name(F.when(F.col("next_").isNull(), F.lit("b")).otherwise(F.col("piece").cast("string"))).alias("to_node"),
    )


def candidate_sets(near: DataFrame, *, target: str, node: str, side: str, distance: str, must: str, reach: float, close: float, each: int = 3) -> DataFrame:
    """Node sets that serve targets: of nodes within close, ``each`` a side by distance, else the nearest node within reach.

    Targets of one set are one row: the least target, their number, and whether any must be visited.
    """
    best = near.where(F.col(distance) <= reach).groupBy(target, side, node).agg(F.min(distance).alias("d_"), F.max(must).alias("must_"))
    order = [F.col("d_"), F.col(node), F.col(side)]
    ranked = best.withColumn("at_side_", F.row_number().over(Window.partitionBy(target, side).orderBy(*order[:2]))).where(F.col("at_side_") <= each)
    ranked = ranked.withColumn("place_", F.row_number().over(Window.partitionBy(target).orderBy(*order)))
    kept = ranked.where((F.col("d_") <= close) | (F.col("place_") == 1))
    sets = kept.groupBy(target).agg(F.array_join(F.array_sort(F.collect_set(node)), ",").alias("nodes"))
    needed = best.groupBy(target).agg(F.max("must_").alias("must_"))
    return sets.join(needed, target).groupBy("nodes").agg(F.min(target).alias(target), F.count(F.lit(1)).alias("n_targets"), F.max("must_").alias(must))


def lattice_residuals(rows: DataFrame, block: str, at: str, unique: str, *, pitch: float, half: int) -> DataFrame:
    """rows with ``residual``: the offset from the lattice of up to half neighbours on each side, the row itself left out (null without any)."""
    turn = F.col(at) * (2 * 3.141592653589793 / pitch)
    by = Window.partitionBy(block).orderBy(at, unique)
    around = lambda of: sum((F.coalesce(step(of, i).over(by), F.lit(0.0)) for i in range(1, half + 1) for step in (F.lag, F.lead)), F.lit(0.0))
    phase = F.atan2(around(F.sin(turn)), around(F.cos(turn))) * (pitch / (2 * 3.141592653589793))
    off = F.col(at) - phase
    alone = F.lag(unique).over(by).isNull() & F.lead(unique).over(by).isNull()
    return rows.withColumn("residual", F.when(~alone, off - pitch * F.floor(off / pitch + 0.5)))


def calibrated_threshold(scores: DataFrame, *, score: str, negative: Column, survives: Column, margin: float, least: float) -> DataFrame:
    """One row: the highest score of surviving negatives (of all, if none survives) plus margin, not under least; null without negatives."""
    top = lambda rule: F.max(F.when(rule, F.col(score)))
    found = scores.agg(top(negative & survives).alias("s_"), top(negative).alias("n_"))
    return found.select(F.when(F.col("n_").isNotNull(), F.greatest(F.coalesce("s_", "n_") + margin, F.lit(least))).alias("threshold"))


def _near(a: DataFrame, b: DataFrame, keys: list[str], at: str, reach: float) -> DataFrame:
    """Pairs of rows of a and b with equal keys and positions at most reach apart; columns get _a and _b. Each pair comes once.

    Sorted on both sides: files are small for their rows, so the engine would send a whole side through the driver.
    """
    cell = F.floor(F.col(at) / reach)
    spread = b.withColumn("cell_", F.explode(F.array(cell - 1, cell, cell + 1)))
    left = a.withColumn("cell_", cell).select(*keys, "cell_", *(F.col(c).alias(f"{c}_a") for c in a.columns if c not in keys))
    right = spread.select(*keys, "cell_", *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys))
    return left.join(right.hint("merge"), [*keys, "cell_"]).drop("cell_").where(F.abs(F.col(f"{at}_a") - F.col(f"{at}_b")) <= reach)


def neighbour_pairs(rows: DataFrame, *, block: str, row: str, at: str, start: str, stop: str, pitch: float, line: float, gap: float) -> DataFrame:
    """Pairs of rows of a block, the one of the lesser position first, with ``kind``.

    ``collinear``: on one line (at most line apart) with at most gap between their ends; ``parallel``: side by side and
    at most 1.5 pitches apart; ``skip``: side by side and at most 2.5. The pair's columns are ``a`` and ``b``, so the block's must bear another name.
    """
    rows = rows.select(block, row, at, start, stop)
    pairs = _near(rows, rows, [block], at, 2.5 * pitch).where(F.struct(f"{at}_a", f"{row}_a") < F.struct(f"{at}_b", f"{row}_b"))
    apart = F.col(f"{at}_b") - F.col(f"{at}_a")
    between = F.greatest(f"{start}_a", f"{start}_b") - F.least(f"{stop}_a", f"{stop}_b")
    kind = F.when((apart <= line) & (between >= 0) & (between <= gap), "collinear").when((apart > line) & (between < 0), F.when(apart <= 1.5 * pitch, "parallel").otherwise("skip"))
    return pairs.withColumn("kind", kind).where("kind IS NOT NULL").select(block, F.col(f"{row}_a").alias("a"), F.col(f"{row}_b").alias("b"), "kind")


def adjacent_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs side by side without a third row that is beside both and between them."""
    beside = pairs.where("kind <> 'collinear'")
    first, second = (beside.select(F.col("a").alias(x), F.col("b").alias(y)) for x, y in (("a", "mid_"), ("mid_", "b")))
    return beside.join(first.join(second, "mid_").select("a", "b").distinct(), ["a", "b"], "left_anti")


def adjacent_rows(rows: DataFrame, *, block: str, row: str, at: str, start: str, stop: str, pitch: float, line: float) -> DataFrame:
    """``adjacent_pairs`` of ``neighbour_pairs``, from the rows: no pair is shuffled.

    All that lies between two rows side by side is near the first of them, so a
    cell of 2.5 pitches and the next one hold all it takes; a task takes those of
    a block. Numeric keys and positions.
    """
    reach = 2.5 * pitch
    cell = F.floor(F.col(at) / reach)
    rows = rows.select(block, row, *(F.col(c).cast("double").alias(c) for c in (at, start, stop))).dropna(subset=[block, at, start, stop])
    dealt = rows.withColumn("own_", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("cell_", F.when(F.col("own_"), cell).otherwise(cell - 1))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(at)
        v, low, high, own = (g[c].to_numpy() for c in (at, start, stop, "own_"))
        first, second = [], []
        last = np.searchsorted(v, v + reach * (1 + 1e-9), "right")
        for i in np.flatnonzero(own):
            j = np.arange(i + 1, last[i])
            j = j[(v[j] - v[i] > line) & (v[j] - v[i] <= reach) & (np.maximum(low[i], low[j]) - np.minimum(high[i], high[j]) < 0)]
            k = between_none(v[j], low[j], high[j], line)
            first.append(np.full(len(k), i))
            second.append(j[k])
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (first, second))
        key, kind = g[row].to_numpy(), np.where(v[b] - v[a] <= 1.5 * pitch, "parallel", "skip").astype(object)
        return pd.DataFrame({"a": key[a], "b": key[b], block: np.full(len(a), g[block].iloc[0]), "kind": kind})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return dealt.groupBy(block, "cell_").applyInPandas(run, f"a {kinds[row]}, b {kinds[row]}, `{block}` {kinds[block]}, kind string")


def between_none(v: np.ndarray, low: np.ndarray, high: np.ndarray, line: float, step: int = 16) -> np.ndarray:
    """Indices of spans, rising in v, that no other one of them overlaps from more than line before."""
    left = np.arange(len(v))
    for m in range(0, len(v), step):
        if not len(left) or v[left[-1]] - v[m] <= line:
            break
        x = np.arange(m, min(m + step, len(v)))[:, None]
        left = left[~((v[left] - v[x] > line) & (np.maximum(low[left], low[x]) - np.minimum(high[left], high[x]) < 0)).any(axis=0)]
    return left


def link_pairs(pieces: DataFrame, *, row: str, col: str, key: str, at: str, start: str, stop: str, offset: float, gap: float) -> DataFrame:
    """Pairs of pieces of touching tiles that may be one row: at most offset aside and gap apart; cost 2 x aside + gap, lesser key first."""
    pieces = pieces.select(row, col, key, at, start, stop)
    tiles = F.array(*(F.struct((F.col(row) + i).alias(row), (F.col(col) + j).alias(col)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    moved = pieces.withColumn("t_", F.explode(tiles)).select("t_.*", key, at, start, stop)
    pairs = _near(pieces, moved, [row, col], at, offset).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    apart = F.greatest(F.greatest(f"{start}_a", f"{start}_b") - F.least(f"{stop}_a", f"{stop}_b"), F.lit(0.0))
    cost = 2 * F.abs(F.col(f"{at}_a") - F.col(f"{at}_b")) + apart
    return pairs.where(apart <= gap).select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"), cost.alias("cost"))


def edit_rows(rows: DataFrame, edits: DataFrame, *, tile: str, row: str, at: str, start: str, stop: str, kind: str, tol: float) -> DataFrame:
    """rows after edits of kind delete, extend and add, with ``action``.

    Delete and extend mean the nearest row of the tile within tol (ties: least row); others have no effect. Delete wins over
    extend; several extends reach over all their spans. Added rows bear the edit's number.
    """
    changes = edits.where(F.col(kind) != "add").groupBy(tile, at).agg(F.max(F.col(kind) == "delete").alias("gone_"), F.min(start).alias("low_"), F.max(stop).alias("high_"))
    firsts = rows.groupBy(tile, at).agg(F.min(row).alias(row))  # of rows at one position only the least is meant
    meant = _near(changes, firsts, [tile], at, tol).groupBy(tile, f"{at}_a").agg(F.min(F.struct(F.abs(F.col(f"{at}_a") - F.col(f"{at}_b")), f"{row}_b")).getField(f"{row}_b").alias(row), *(F.first(f"{c}_a").alias(c) for c in ("gone_", "low_", "high_")))
    by_row = meant.groupBy(tile, row).agg(F.max("gone_").alias("gone_"), F.min("low_").alias("low_"), F.max("high_").alias("high_"))
    kept = rows.join(by_row, [tile, row], "left").where("gone_ IS NULL OR NOT gone_")
    action = F.when(F.col("gone_").isNull(), "kept").otherwise("extended")
    kept = kept.select(tile, row, at, F.least(start, "low_").alias(start), F.greatest(stop, "high_").alias(stop), action.alias("action"))
    return kept.unionByName(edits.where(F.col(kind) == "add").select(tile, row, at, start, stop, F.lit("added").alias("action")))
