"""Evaluation: confusion, macro-F1, pair counting, gates, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.numbers import f1_from_counts, round_up


def confusion(df: DataFrame, ref: str, pred: str) -> DataFrame:
    return df.groupBy(ref, pred).agg(F.count(F.lit(1)).alias("n"))


def attribute_scores(df: DataFrame, ref: str, pred: str, labels: Sequence | None = None) -> DataFrame:
    """accuracy and macro-F1 over reference values and predicted known labels; a missing prediction is wrong. No rows: both 1."""
    c = confusion(df.where(F.col(ref).isNotNull()), ref, pred)
    total = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_"), F.coalesce(F.sum(F.when(F.col(ref) == F.col(pred), F.col("n"))), F.lit(0)).alias("hit_"))
    a = c.select(F.col(ref).alias("c"), F.col("n").alias("r"), F.lit(0).alias("p"), F.when(F.col(ref) == F.col(pred), F.col("n")).otherwise(0).alias("t"), F.lit(True).alias("known"))
    known = F.col(pred).isin(*labels) if labels is not None else F.lit(True)
    b = c.where(F.col(pred).isNotNull()).select(F.col(pred).alias("c"), F.lit(0).alias("r"), F.col("n").alias("p"), F.lit(0).alias("t"), known.alias("known"))
    per = a.unionByName(b).groupBy("c").agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("t").alias("t"), F.bool_or("known").alias("known")).where("known")
    macro = per.agg(F.coalesce(F.avg(f1_from_counts(F.col("t"), F.col("p"), F.col("r"))), F.lit(1.0)).alias("macro_"))
    return total.crossJoin(macro).select(F.when(F.col("all_") == 0, 1.0).otherwise(round_up(F.col("hit_") / F.greatest("all_", F.lit(1)), 6)).alias("accuracy"), round_up(F.col("macro_"), 6).alias("macro_f1"))


def grouping_consistency(df: DataFrame, ref: str, pred: str) -> DataFrame:
    """Pair-counting F1 of two partitions; blank and null groups are singletons."""
    pairs = lambda n: F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))
    some = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    both = df.where(some(ref) & some(pred)).groupBy(ref, pred).agg(F.count(F.lit(1)).alias("n")).agg(pairs(F.col("n")).alias("tp"))
    r = df.where(some(ref)).groupBy(ref).agg(F.count(F.lit(1)).alias("n")).agg(pairs(F.col("n")).alias("r"))
    p = df.where(some(pred)).groupBy(pred).agg(F.count(F.lit(1)).alias("n")).agg(pairs(F.col("n")).alias("p"))
    return both.crossJoin(r).crossJoin(p).select("tp", F.col("r").alias("ref_pairs"), F.col("p").alias("pred_pairs"), round_up(F.when(F.col("p") + F.col("r") == 0, 1.0).otherwise(2 * F.col("tp") / (F.col("p") + F.col("r"))), 6).alias("f1"))


def merge_stats(parts: DataFrame, key: str, sums: Sequence[str], sets: Sequence[str] = ()) -> DataFrame:
    """Merge of partial statistics: sums add up, sets unite."""
    return parts.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets))


def mean_of_tiles(per_tile: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean per metric of finite values; null when there is none."""
    v = F.col(value)
    finite = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return per_tile.groupBy(metric).agg(round_up(F.avg(finite), 6).alias("mean"), F.when(F.count(F.lit(1)) == F.count(finite), F.min(finite)).alias("least"))


def evaluate_gates(means: DataFrame, gates: DataFrame, metric: str) -> DataFrame:
    """Gates (metric, on: mean or least, minimum) against the means; null values fail."""
    j = gates.join(means, metric, "left")
    value = F.when(F.col("on") == "least", F.col("least")).otherwise(F.col("mean"))
    return j.select(metric, "on", "minimum", value.alias("value"), F.coalesce(value >= F.col("minimum"), F.lit(False)).alias("passed"))


def compare_to_baseline(current: DataFrame, baseline: DataFrame, keys: Sequence[str], value: str, *, max_drop: float) -> DataFrame:
    """Baseline values that the current run misses or falls short of by more than ``max_drop``."""
    j = baseline.select(*keys, F.col(value).alias("was")).join(current.select(*keys, F.col(value).alias("now")), list(keys), "left")
    return j.where(F.col("now").isNull() | (F.col("was") - F.col("now") > max_drop))


def promote(scores: DataFrame, variant: str, tile: str, score: str, order: str, baseline: str) -> DataFrame:
    """The best-mean variant that beats the baseline on every tile (ties: the earlier), else the baseline."""
    base = scores.where(F.col(variant) == baseline).select(tile, F.col(score).alias("base_"))
    per = scores.where(F.col(variant) != baseline).join(base, tile, "right").groupBy(variant, order).agg(F.bool_and(F.coalesce(F.col(score) > F.col("base_"), F.lit(False))).alias("beats_"), F.avg(score).alias("mean_"), F.count(F.lit(1)).alias("n_"))
    size = base.agg(F.count(F.lit(1)).alias("tiles_"))
    ok = per.crossJoin(size).where(F.col("beats_") & (F.col("n_") == F.col("tiles_")))
    return ok.agg(F.coalesce(F.max_by(variant, F.struct("mean_", (-F.col(order)).alias("o"))), F.lit(baseline)).alias("chosen"))
