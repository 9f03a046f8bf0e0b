"""Pieces of rows joined to chains under a rule that refuses unions, as one by one, in rounds.

Links are taken in order of (cost, link); one is refused if the chains it would
join hold two members of one tile that overlap by more than a tolerance. Chains
only grow, so what clashes stays in clash, and each round first drops the links
of all chains that do. Then it settles the larger of two sets of links, both as
in the one-by-one order: those that are the least of both their chains (no
earlier link touches either), or the first ``settle`` of all, which one pass
takes one by one with what their chains hold. Wide data goes by the first way;
where all links meet few chains, which settle one each, it goes by the second.
Of links between two chains only the first goes on. No block or tile is in one
task, and a pass holds ``settle`` links and HELD members at most.

Members meet as different places: a chain asks the larger one it has a link to
about each place of its own, and equal questions are answered once, by windows.
A member without a tile or an end, or no longer than the tolerance, clashes with none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from fieldlark.session import Steps


SETTLE = 200_000  # links that one pass takes
HELD = 1_000_000  # members that one pass holds


def chains(pieces: DataFrame, links: DataFrame, *, overlap: float, settle: int = SETTLE, most_rounds: int = 10_000, held: int = HELD) -> DataFrame:
    """(piece, chain): chain is its least piece. pieces: (piece, tile, low, high), numbers; links: (a, b, cost, link), link unique, a and b pieces."""
    steps = Steps(pieces.sparkSession)
    members = steps.put("members", pieces.select("piece", F.col("piece").alias("chain"), "tile", *(F.col(c).cast("double").alias(c) for c in ("low", "high"))))
    live = steps.put("live", _one_each(links.where("a <> b").select("link", "cost", F.col("a").alias("ca"), F.col("b").alias("cb"))))
    for _ in range(most_rounds):
        n = live.count()
        if not n:
            return members.select("piece", "chain")
        places = members.where(F.col("tile").isNotNull() & ~F.isnan("low") & ~F.isnan("high") & (F.col("high") - F.col("low") > overlap)).select("chain", "tile", "low", "high")
        first = steps.put("first", _first(live, places, n, settle, held)) if n <= settle else None
        if first is None or first.isEmpty():
            live = steps.put("live", live.join(_clashing(live, places, overlap), ["ca", "cb"], "left_anti"))
            joined = steps.put("joined", _least_of_both(live))
            first = steps.put("first", _first(live, places, live.count(), settle, held)) if joined.count() < settle else None
        if first is not None and not first.isEmpty():
            joined = steps.put("joined", _one_by_one(first, places, overlap))
            live = live.join(first.select("link"), "link", "left_anti")
        members = steps.put("members", _moved(members, joined, "chain").select("piece", "chain", "tile", "low", "high"))
        live = steps.put("live", _one_each(_moved(_moved(live, joined, "ca"), joined, "cb").where("ca <> cb")))
    raise RuntimeError("links are left after the most rounds")


def _moved(df: DataFrame, joined: DataFrame, c: str) -> DataFrame:
    to = joined.select(F.col("old").alias(c), F.col("new").alias("to_"))
    return df.join(to, c, "left").withColumn(c, F.coalesce("to_", c)).drop("to_")


def _one_each(live: DataFrame) -> DataFrame:
    """The first link between any two chains."""
    return live.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("cost", "link")).alias("m")).select("m.*", "ca", "cb")


def _least_of_both(live: DataFrame) -> DataFrame:
    """(old, new) of links that are the least of both their chains."""
    ends = live.select("cost", "link", F.explode(F.array("ca", "cb")).alias("chain"))
    least = ends.groupBy("chain").agg(F.min(F.struct("cost", "link")).alias("m")).select("chain", "m.link")
    now = least.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("link")
    return live.join(now, "link").select(F.col("cb").alias("old"), F.col("ca").alias("new"))


def _clashing(live: DataFrame, places: DataFrame, overlap: float) -> DataFrame:
    """(ca, cb) of links whose chains clash.

    Of members that begin before a place only the furthest end counts, of those
    that begin after it only the nearest: all are longer than the tolerance.
    """
    size = places.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    sized = live.select("ca", "cb").join(size.select(F.col("chain").alias("ca"), F.col("n").alias("na")), "ca").join(size.select(F.col("chain").alias("cb"), F.col("n").alias("nb")), "cb")
    fewer = F.col("na") < F.col("nb")
    asks = sized.select("ca", "cb", F.when(fewer, F.col("ca")).otherwise(F.col("cb")).alias("chain"), F.when(fewer, F.col("cb")).otherwise(F.col("ca")).alias("asked")).join(places, "chain")
    at = ["asked", "tile", "low", "high"]
    own = places.withColumnRenamed("chain", "asked").join(asks.select("asked").distinct(), "asked", "left_semi")
    both = asks.select(*at).distinct().withColumn("asks", F.lit(True)).unionByName(own.withColumn("asks", F.lit(False)))
    w = Window.partitionBy("asked", "tile").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.max(F.when(~F.col("asks"), F.col("high"))).over(w.orderBy("low"))
    start = F.min(F.when(~F.col("asks"), F.col("low"))).over(w.orderBy(F.col("low").desc()))
    met = both.withColumn("end", end).withColumn("start", start).where("asks").where((F.col("end") - F.col("low") > overlap) | (F.col("high") - F.col("start") > overlap))
    return asks.join(met.select(*at), at, "left_semi").select("ca", "cb").distinct()


def _first(live: DataFrame, places: DataFrame, n: int, settle: int, held: int) -> DataFrame:
    """The first ``settle`` links, or as many of them that their chains hold ``held`` members at most; none if that many are in one chain."""
    if n > settle:
        cost = F.col("cost").cast("double")
        cut = live.agg(F.percentile_approx(cost, settle / n, 10_000)).first()[0]
        live = live.where(F.col("cost").isNull() | (cost <= cut)).orderBy("cost", "link").limit(settle)
    met = live.select(F.struct("cost", "link").alias("at"), F.explode(F.array("ca", "cb")).alias("chain")).groupBy("chain").agg(F.min("at").alias("at"))
    size = places.groupBy("chain").agg(F.count(F.lit(1)).alias("n")).join(met, "chain")
    if (size.agg(F.sum("n")).first()[0] or 0) <= held:
        return live
    over = size.select("at", F.sum("n").over(Window.orderBy("at")).alias("sum_")).where(F.col("sum_") > held).agg(F.min("at").alias("over_"))
    return live.crossJoin(F.broadcast(over)).where(F.struct("cost", "link") < F.col("over_")).drop("over_")


def _one_by_one(first: DataFrame, places: DataFrame, overlap: float) -> DataFrame:
    """(old, new) of the chains that links join when they are taken one by one in one pass: rows with a link are links, the others members."""
    ends = first.select(F.explode(F.array("ca", "cb")).alias("chain")).distinct()
    null = lambda like, *names: [F.lit(None).cast(like.schema[n].dataType).alias(n) for n in names]
    rows = first.select("ca", "cb", "cost", "link", *null(places, "tile", "low", "high"))
    rows = rows.unionByName(places.join(ends, "chain", "left_semi").select(F.col("chain").alias("ca"), "tile", "low", "high", *null(first, "cb", "cost", "link")))
    kind = first.schema["ca"].dataType
    return rows.repartition(1).mapInArrow(_pass(overlap), StructType([StructField(n, kind) for n in ("old", "new")]))


def _pass(overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held, spans = [], defaultdict(list), defaultdict(dict)  # spans: chain -> tile -> (starts, rising; the furthest end up to each)

        def hold(chain, tile, low: float, high: float) -> None:
            starts, ends = spans[chain].setdefault(tile, ([], []))
            i = bisect_right(starts, low)
            starts.insert(i, low)
            ends.insert(i, max(high, ends[i - 1]) if i else high)
            while (i := i + 1) < len(ends) and ends[i] < high:
                ends[i] = high

        def clash(few, many) -> bool:
            for tile, low, high in held[few]:
                if at := spans[many].get(tile):
                    i = bisect_right(at[0], low)
                    if i and at[1][i - 1] - low > overlap or i < len(at[0]) and high - at[0][i] > overlap:
                        return True
            return False

        for batch in batches:
            schema = batch.schema
            for ca, cb, cost, link, tile, low, high in zip(*(batch.column(c).to_pylist() for c in ("ca", "cb", "cost", "link", "tile", "low", "high"))):
                if link is not None:
                    links.append(((cost is not None, cost), link, ca, cb))
                else:
                    held[ca].append((tile, low, high))
                    hold(ca, tile, low, high)
        up, name = {}, {}

        def root(c):
            while (over := up.setdefault(c, c)) != c:
                up[c] = c = up[over]
            return c

        for _, _, a, b in sorted(links):
            a, b = root(a), root(b)
            few, many = (a, b) if len(held[a]) < len(held[b]) else (b, a)
            if a == b or clash(few, many):
                continue
            for span in held[few]:
                hold(many, *span)
            held[many] += held.pop(few)
            spans.pop(few, None)
            up[few], name[many] = many, min(name.get(a, a), name.get(b, b))
        moved = [(c, new) for c in up if (new := name.get(r := root(c), r)) != c]
        if moved:
            kind = schema.field("ca").type
            yield pa.RecordBatch.from_arrays([pa.array(side, kind) for side in zip(*moved)], names=["old", "new"])

    return run


def split_unsupported(members: DataFrame, *, longest: float) -> DataFrame:
    """(chain, part, piece): chains cut where no member covers a stretch over ``longest``; members: (chain, piece, low, high), places along the chain.

    Parts count from 0 along the chain. A chain's members are ordered by a window.
    """
    w = Window.partitionBy("chain").orderBy("low", "piece")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("low") - reach > longest).cast("int"), F.lit(0))
    return members.withColumn("cut_", cut).select("chain", F.sum("cut_").over(w).alias("part"), "piece")
