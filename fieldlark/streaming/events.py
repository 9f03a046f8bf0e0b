"""Event streams: windows with watermarks, silence sessions, latest state, stage timings.

The same functions take static and streaming DataFrames; state is bounded by
the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _marked(events: DataFrame, at: str, late: str) -> DataFrame:
    return events.withWatermark(at, late) if events.isStreaming else events


def read_event_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines folder as a stream."""
    return spark.readStream.schema(schema).json(path)


def windowed(events: DataFrame, at: str, key: str, value: str, *, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """n, sum and largest value per key and tumbling or sliding window."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return _marked(events, at, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("top")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n", "total", "top")


def silences(events: DataFrame, at: str, key: str, *, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that a silence of ``gap`` ends: the watchdog's stop is ``stop``."""
    s = _marked(events, at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def latest(events: DataFrame, at: str, key: str, state: str, unique: str) -> DataFrame:
    """The last state of each key (update or complete mode on streams)."""
    last = events.groupBy(key).agg(F.max(F.struct(at, unique, state)).alias("m"))
    return last.select(key, F.col(f"m.{at}").alias(at), F.col(f"m.{state}").alias(state))


def changes(batch: DataFrame, known: DataFrame, key: str, state: str) -> DataFrame:
    """Keys whose state in a batch differs from the known one: rows to notify."""
    k = known.select(F.col(key).alias("k_"), F.col(state).alias("was"))
    return batch.join(k, F.col(key) == F.col("k_"), "left").where(~F.col(state).eqNullSafe(F.col("was"))).select(key, "was", F.col(state).alias("now"))


def to_folder(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """All that is there now, then stop; goes on from its checkpoint when called again."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
