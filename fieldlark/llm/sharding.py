"""Uniform shuffle of a table into shards of exact sizes.

A communication matrix says how many rows each input partition sends to each
shard; its rows are multivariate hypergeometric draws, so all ways to deal the
rows out are equally likely and shard sizes are exact (at most one apart). Each
partition permutes the resulting labels over its rows, rows are exchanged by
(shard, part of shard), and each part is permuted again; parts are random, of
bounded size, and placed end to end.

The matrix has a row per input partition and is the only thing the driver
holds; offsets of parts are broadcast up to BROADCAST_PARTS and joined beyond.
Labels depend on (seed, partition, row in partition) alone, so a lost
task makes the same ones again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_PARTS = 65_536
_ROW_BITS = 33  # of monotonically_increasing_id


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without return are good; exact law at any size."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)  # inversion around the mode
    total = good + bad
    spread = int(40 * (n * (good / total) * (bad / total)) ** 0.5) + 64
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[1:]) - np.log(bad - n + k[1:])
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    p = np.exp(log_p - log_p.max())
    c = np.cumsum(p)
    return int(k[0]) + int(np.searchsorted(c, rng.random() * c[-1], "right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[p, s]: rows that partition p sends to shard s; columns differ by one at most."""
    rng = np.random.Generator(np.random.PCG64([seed, 1]))
    total = sum(rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        rest = sum(left)
        for s in range(shards):
            rest -= left[s]
            out[p, s] = c = hypergeometric(rng, left[s], rest, n)
            left[s] -= c
            n -= c
    return out


def shard_rows(docs: DataFrame, *, shards: int = 8, seed: int = 20240229, part_rows: int = 5_000) -> DataFrame:
    """The rows of ``docs`` with ``shard`` int and ``slot`` long (gapless from 0 in its shard).

    All columns of ``docs`` are kept; columns named shard or slot are replaced.
    Null values, empty or long texts and repeated rows play no part: every row
    is dealt out once. An empty table gives no row. ``docs`` whose plan holds an
    exchange is checkpointed first, since its partitions must read alike twice.
    """
    if any(x in docs._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "AdaptiveSparkPlan", "Python", "MapInArrow")):
        docs = docs.checkpoint()
    docs = docs.drop("shard", "slot")
    found = {r.p: r.n for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    matrix = communication_matrix(rows, shards, seed)
    total = sum(rows)
    parts = max(1, -(-total // (shards * part_rows)))

    @F.pandas_udf("int")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, labels = -1, np.zeros(0, np.int32)
        for ids in batches:
            if not len(ids):
                yield pd.Series([], dtype="int32")
                continue
            here = int(ids.iloc[0]) >> _ROW_BITS
            if here != of:
                of = here
                labels = np.repeat(np.arange(shards, dtype=np.int32), matrix[of]) if of < len(matrix) else labels[:0]
                np.random.Generator(np.random.PCG64([seed, 2, of])).shuffle(labels)
            at = ids.to_numpy() & ((1 << _ROW_BITS) - 1)
            if at.max() >= len(labels):
                raise RuntimeError("a partition has more rows than were counted: the input doesn't read alike twice")
            yield pd.Series(labels[at])

    clash = {c.lower() for c in docs.columns}
    row, part, draw = (next(f"{n}{'_' * k}" for k in range(99) if f"{n}{'_' * k}" not in clash) for n in ("dealt_row", "dealt_part", "dealt_draw"))
    dealt = docs.withColumn(row, F.monotonically_increasing_id()).withColumn("shard", label(row))
    dealt = dealt.withColumn(draw, F.xxhash64(F.lit(seed), row)).withColumn(part, F.pmod(F.xxhash64(F.lit(seed + 1), row), F.lit(parts)))
    sizes = dealt.groupBy("shard", part).agg(F.count(F.lit(1)).alias("n"))
    first = "first_slot" if "first_slot" not in clash else "first_slot_"
    offsets = sizes.select("shard", part, (F.sum("n").over(Window.partitionBy("shard").orderBy(part)) - F.col("n")).alias(first))
    order = Window.partitionBy("shard", part).orderBy(draw, row)
    placed = dealt.withColumn("slot", F.row_number().over(order).cast("long"))
    placed = placed.join(F.broadcast(offsets) if shards * parts <= BROADCAST_PARTS else offsets, ["shard", part])
    return placed.select(*docs.columns, "shard", (F.col("slot") - 1 + F.col(first)).alias("slot"))
