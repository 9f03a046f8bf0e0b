"""Tables and queries as temp views, with row policies as predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import QUERIES


def register_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def register_query(spark: SparkSession, folder: str, name: str, view: str | None = None) -> None:
    QUERIES[name](spark, folder).createOrReplaceTempView(view or name)


def visible(df: DataFrame, tenant: Column, mine: str | None, *, admin: bool, published: Column | None = None) -> DataFrame:
    """All rows for an admin; else one's own tenant's and published ones."""
    if admin:
        return df
    own = F.lit(False) if mine is None else F.coalesce(tenant == mine, F.lit(False))
    return df.where(own if published is None else own | F.coalesce(published, F.lit(False)))


def public(df: DataFrame, private: Iterable[str]) -> DataFrame:
    return df.drop(*private)


def assignment_notices(tasks: DataFrame, key: str, assignee: str, at: str) -> DataFrame:
    """(key, was, now, at) of every change of assignee in a task's history, the first included."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(at)
    out = tasks.select(key, F.lag(assignee).over(w).alias("was"), F.col(assignee).alias("now"), at)
    return out.where(F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("was")))
