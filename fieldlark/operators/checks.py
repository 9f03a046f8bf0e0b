"""Validation as queries: every check gives issue rows (severity, code, object_id, detail)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.functions.text import normalize_enum, padded

#: Severities from worst.
SEVERITIES = ("error", "warning", "info")


def _issue(df: DataFrame, severity: str, code: str, object_id: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), object_id.cast("string").alias("object_id"), detail.cast("string").alias("detail"))


def missing_attributes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null or blank required attributes, in one scan."""
    bad = F.filter(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return _issue(df.select(key, F.explode(bad).alias("attribute")), "error", "missing_attribute", F.col(key), F.col("attribute"))


def enum_values(df: DataFrame, key: str, column: str, allowed: Iterable[str], synonyms: Mapping[str, str] | None = None) -> DataFrame:
    """Values that only normalising makes allowed (warning), or that nothing does (error)."""
    allowed = sorted(allowed)
    known = normalize_enum(F.col(column), allowed, synonyms)
    odd = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(key, column, known.alias("known_"))
    return odd.select(F.when(F.col("known_").isNull(), "error").otherwise("warning").alias("severity"), F.when(F.col("known_").isNull(), "enum_bad").otherwise("enum_normalised").alias("code"), F.col(key).cast("string").alias("object_id"), F.col(column).alias("detail"))


def untrimmed(df: DataFrame, key: str, column: str) -> DataFrame:
    return _issue(df.where(F.col(column) != F.trim(column)), "warning", "whitespace", F.col(key), F.col(column))


def case_collisions(df: DataFrame, column: str) -> DataFrame:
    """(folded, spellings, majority) of values that are equal up to case; ties of the majority go to the least spelling."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("folded"), F.col(column).alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    out = n.groupBy("folded").agg(F.array_join(F.array_sort(F.collect_list("v_")), ";").alias("spellings"), F.min_by("v_", F.struct((-F.col("n_")).alias("n"), F.col("v_").alias("v"))).alias("majority"), F.count(F.lit(1)).alias("k_"))
    return out.where("k_ > 1").drop("k_")


def missing_keys(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return _issue(expected.select(key).distinct().join(present.select(key), key, "left_anti"), "error", "missing", F.col(key), F.lit(None))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    return _issue(n, "error", "duplicate_key", F.concat_ws("|", *keys), F.col("n_"))


def compare_sets(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison: missing, unexpected or different."""
    e, a = expected.select(key, F.col(value).alias("e_"), F.lit(1).alias("in_e")), actual.select(key, F.col(value).alias("a_"), F.lit(1).alias("in_a"))
    both = e.join(a, key, "full_outer")
    code = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(~F.col("e_").eqNullSafe(F.col("a_")), "different")
    return both.select(F.lit("error").alias("severity"), code.alias("code"), F.col(key).cast("string").alias("object_id"), F.concat_ws(" / ", F.col("e_").cast("string"), F.col("a_").cast("string")).alias("detail")).where(F.col("code").isNotNull())


def out_of_range(df: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    return _issue(df.where((F.col(column) < low) | (F.col(column) > high)), "error", "out_of_range", F.col(key), F.col(column))


def dense_order(df: DataFrame, group: str, column: str) -> DataFrame:
    """Groups whose order numbers are not 1..n, each once."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_"), F.count_distinct(column).alias("d_"), F.min(column).alias("a_"), F.max(column).alias("b_"))
    return _issue(n.where("a_ <> 1 or b_ <> n_ or d_ <> n_"), "error", "order_not_dense", F.col(group), F.col("n_"))


def all_issues(*found: DataFrame) -> DataFrame:
    """Union of checks with a number by severity rank, code, object and detail."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("severity"))
    # numbered in ranges of (rank, code): counts of those come first, then each range by itself
    sizes = out.groupBy(rank.alias("r_"), "code").agg(F.count(F.lit(1)).alias("n_")).select("r_", "code", (F.sum("n_").over(Window.orderBy("r_", "code")) - F.col("n_")).alias("before_"))
    own = Window.partitionBy("r_", "code").orderBy("object_id", "detail")
    numbered = out.withColumn("r_", rank).withColumn("own_", F.row_number().over(own)).join(F.broadcast(sizes), ["r_", "code"])
    return numbered.select(F.concat(F.lit("Q"), padded(F.col("own_") + F.col("before_"), 5)).alias("issue_id"), "severity", "code", "object_id", "detail")


def summarize_issues(issues: DataFrame, tile: str) -> DataFrame:
    """Errors, warnings, sorted codes and priority (1 error, 2 warning, 3 clean) per tile."""
    return issues.groupBy(tile).agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.array_join(F.array_sort(F.collect_set("code")), ";").alias("codes"),
        F.when(F.bool_or(F.col("severity") == "error"), 1).when(F.bool_or(F.col("severity") == "warning"), 2).otherwise(3).alias("priority"),
    )


def review_queue(tiles: DataFrame, summary: DataFrame, tile: str) -> DataFrame:
    """Every tile with its summary, zeros where nothing was found."""
    j = tiles.join(summary, tile, "left")
    return j.select(tile, F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("priority", F.lit(3)).alias("priority"))


def sum_check(parts: Column, whole: Column, n_values: Column, *, tol: float, unit: float) -> Column:
    """|parts - whole| within a fixed tolerance and half a unit of every written value."""
    return F.abs(parts - whole) <= tol + 0.5 * unit * n_values
