"""Dated URL lists applied to captures as of their fetch time.

A list entry names a host (and all hosts under it), a path beginning and an
action from a date on: ``block``, ``allow`` or ``end`` (the entry is taken off).
The entries of one (host, path) follow each other by date, so each holds from
its date until the next one's (validity intervals). An as-of join evaluates a
capture against the entries in force when it was fetched; of those the longest
host wins, then the longest path, then the latest date.

Each distinct (host, path, time) is judged once. It is laid out as keys: every
ending of its host that is listed, with the path's beginnings of the lengths
which that listed host has. Keys meet entries by equality of host and path, so
a host of a million listed paths costs a capture no more than its own path's
beginnings, and no row holds a host's whole list. Captures are dealt by host,
path and time together: a host with a third of all captures spreads over its
paths and days. A list of at most ``BROADCAST_ENTRIES`` is broadcast; beyond
that the same joins shuffle, and the engine's skew join splits hot endings.

A null, empty or unparseable URL has host "" and is kept, as is a capture
without a fetch time; entries with a null host, date or action are left out; a
null path holds for every path. Of entries with equal host, path and date the
last by (action, category) holds. Repeated captures are judged alike. An empty
list keeps everything; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ENTRIES = 200_000

#: host, path beginning, first day, action, category
PRODUCTION_LIST = (
    ("cheap-pills.example.net", "", "2019-03-01", "block", "pharmacy"),
    ("casino-win.example.net", "", "2019-03-01", "block", "gambling"),
    ("free-bets.example.net", "", "2020-06-15", "block", "gambling"),
    ("ads-track.example.com", "", "2018-11-20", "block", "tracking"),
    ("adult-x.example.com", "", "2017-01-05", "block", "adult"),
    ("spam-farm.example.org", "", "2021-09-30", "block", "spam"),
    ("ththor.example.com", "", "2024-02-01", "block", "spam"),
    ("ththor.example.com", "", "2024-05-01", "end", "spam"),
    ("ththor.example.com", "/en", "2024-03-01", "allow", "reviewed"),
    ("thther.example.org", "/fr", "2024-01-15", "block", "malware"),
    ("thther.example.org", "/fr", "2024-07-15", "allow", "reviewed"),
    ("tiontion.example.com", "", "2024-08-01", "block", "spam"),
    ("m.tiontion.example.com", "", "2024-09-01", "allow", "reviewed"),
    ("tionsh.example.net", "/de", "2024-10-10", "block", "malware"),
)


def list_entries(spark: SparkSession, entries: tuple = PRODUCTION_LIST) -> DataFrame:
    """(host, path, since, action, category) of a written list."""
    if not entries:
        return spark.sql("SELECT '' AS host, '' AS path, DATE'1970-01-01' AS since, '' AS action, '' AS category WHERE false")
    quote = lambda x: "NULL" if x is None else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({', '.join(map(quote, e))})" for e in entries)
    return spark.sql(f"SELECT host, path, CAST(since AS DATE) AS since, action, category FROM VALUES {rows} AS list(host, path, since, action, category)")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a CSV file or folder with a header line: host, path, since (yyyy-MM-dd), action, category."""
    return spark.read.csv(path, header=True, schema="host string, path string, since date, action string, category string")


def intervals(entries: DataFrame) -> DataFrame:
    """(host, path, since, until, action, category): when each entry holds; ``end`` entries are gone."""
    clean = entries.where("host is not null and since is not null and action is not null").select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "since", "action", F.coalesce("category", F.lit("")).alias("category"))
    day = Window.partitionBy("host", "path", "since").orderBy(F.col("action").desc(), F.col("category").desc())
    once = clean.withColumn("turn", F.row_number().over(day)).where("turn = 1").drop("turn")
    until = F.lead("since").over(Window.partitionBy("host", "path").orderBy("since"))
    return once.withColumn("until", until).where("action <> 'end'")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; "" where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def filter_urls(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """The captures with host, decision (keep, drop), category and rule (host + path, null if none holds).

    All columns are kept; columns of those names are replaced.
    """
    added = ("host", "decision", "category", "rule")
    rest = [c for c in captures.columns if c.lower() not in added]
    base = captures.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(time_col).alias("at"))
    in_force = intervals(entries).withColumnRenamed("host", "listed")
    few = in_force.select(F.count(F.lit(1)).alias("n")).first()["n"] <= BROADCAST_ENTRIES
    small = F.broadcast if few else (lambda df: df)
    lengths = in_force.groupBy("listed").agg(F.collect_set(F.length("path")).alias("lengths"))  # at most one per length of a path
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = base.select("host", "path", "at").where("host <> '' and at is not null").distinct()
    under = asked.withColumn("listed", F.explode(endings)).join(small(lengths), "listed")
    keys = under.withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path"))
    keys = keys.select("host", F.col("path").alias("whole"), "at", "listed", F.substring("path", F.lit(1), F.col("n")).alias("path"))
    held = keys.join(small(in_force), ["listed", "path"]).where("since <= at and (until is null or at < until)")
    item = F.struct(F.length("listed").alias("l"), F.length("path").alias("p"), "since", "action", "category", "listed", "path")
    best = held.groupBy("host", "whole", "at").agg(F.max(item).alias("best")).withColumnRenamed("whole", "path")
    return base.join(best, ["host", "path", "at"], "left").select(
        "row.*",
        "host",
        F.when(F.col("best.action") == "block", "drop").otherwise("keep").alias("decision"),
        F.col("best.category").alias("category"),
        F.concat("best.listed", "best.path").alias("rule"),
    )


def capture_day(page_id: Column) -> Column:
    """The day a page was fetched, for tables without one: page ids cycle through 2024."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(366)).cast("int"))


def oracle() -> str:
    """DuckDB SQL of the registered query."""
    rows = ", ".join(f"('{h}', '{p}', DATE '{d}', '{a}', '{c}')" for h, p, d, a, c in PRODUCTION_LIST)
    return f"""
WITH list(host, path, since, action, category) AS (VALUES {rows}),
spans AS (SELECT *, lead(since) OVER (PARTITION BY host, path ORDER BY since) AS until FROM list),
pages_at AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS url_path
  FROM pages),
hits AS (
  SELECT p.page_id, s.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.host) DESC, length(s.path) DESC, s.since DESC) AS turn
  FROM pages_at p JOIN spans s ON (p.host = s.host OR ends_with(p.host, '.' || s.host))
    AND s.action <> 'end' AND s.since <= p.day AND (s.until IS NULL OR p.day < s.until) AND starts_with(p.url_path, s.path))
SELECT p.page_id, p.url, CAST(p.day AS VARCHAR) AS fetched_on, p.host,
  CASE WHEN h.action = 'block' THEN 'drop' ELSE 'keep' END AS decision, h.category, h.host || h.path AS rule
FROM pages_at p LEFT JOIN hits h ON h.page_id = p.page_id AND h.turn = 1
"""
