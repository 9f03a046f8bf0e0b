"""Least connections of lines and the walking graph made of them.

``least_connections`` is a spanning forest of least weight in rounds: each
component takes its cheapest link to another (ties: the lesser ends), components
that took a link to each other become one, and of parallel links the cheapest
goes on. Components at least halve in number each round. Once ``settle`` links
or fewer are left, one Arrow pass takes them in order of weight. The result is
unique, as links are ordered by (weight, ends).

A graph's node is a place on a line: line * 2**32 + position, so that no table of
nodes is needed; positions are whole numbers (millimetres) below 2**32.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.operators.graph import components
from fieldlark.operators.spatial import box_join, within_distance
from fieldlark.session import Steps

SETTLE = 200_000


def least_connections(links: DataFrame, weight: str, *, joins: tuple[str, str] | None = None, settle: int = SETTLE) -> DataFrame:
    """(a, b, weight): the links of a least spanning forest. links: (a, b, weight), joins: columns of what a and b belong to (else a and b)."""
    ca, cb = joins or ("a", "b")
    steps = Steps(links.sparkSession)
    pick = lambda df: df.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("m")).select("ca", "cb", "m.*")
    live = links.where(F.col(ca) != F.col(cb)).select(F.col(ca).alias("ca"), F.col(cb).alias("cb"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col(weight).alias("w"))
    live, taken = steps.put("live", pick(live)), []
    while (n := live.count()) > settle:
        both = live.select("ca", "w", "a", "b", "cb").unionAll(live.select("cb", "w", "a", "b", "ca"))
        best = both.groupBy("ca").agg(F.min(F.struct("w", "a", "b", "cb")).alias("m")).select("ca", "m.*")
        taken.append(steps.put(f"taken{len(taken)}", best))
        of = steps.put("of", components(taken[-1].select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        side = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
        moved = live.join(side("ca"), "ca").join(side("cb"), "cb").where("ca_ <> cb_").select(F.col("ca_").alias("ca"), F.col("cb_").alias("cb"), "w", "a", "b")
        live = steps.put("live", pick(moved))
    if n:
        schema = live.select("a", "b", "w").schema
        taken.append(live.coalesce(1).mapInArrow(_in_order, schema))
    out = live.select("a", "b", "w").limit(0)
    for t in taken:
        out = out.unionByName(t.select("a", "b", "w"))
    return out.distinct().withColumnRenamed("w", weight)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b, w) of a forest over ca, cb: by weight, each that joins two trees."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches).sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
    root: dict = {}

    def find(v):
        while (up := root.setdefault(v, v)) != v:
            root[v] = v = root[up]
        return v

    keep = []
    for i, (p, q) in enumerate(zip(table.column("ca").to_pylist(), table.column("cb").to_pylist())):
        p, q = find(p), find(q)
        if p != q:
            root[q] = p
            keep.append(i)
    yield from table.take(keep).select(["a", "b", "w"]).to_batches()


def node(line: Column, at: Column) -> Column:
    return F.shiftleft(line.cast("long"), 32) + at.cast("long")


def plan_connectors(stops: DataFrame, *, reach: float) -> DataFrame:
    """(a, b, length): the fewest, shortest connectors that join all lines they can. stops: (line, at, x, y), places where a line may be left.

    Two stops of different lines at most ``reach`` apart may be joined; length
    is their distance in whole thousandths.
    """
    near = within_distance(stops, stops, limit=reach).where("l_line < r_line")
    length = F.floor(F.sqrt(F.pow(F.col("l_x") - F.col("r_x"), 2) + F.pow(F.col("l_y") - F.col("r_y"), 2)) * 1000 + 0.5)
    links = near.select(F.col("l_line").alias("ca"), F.col("r_line").alias("cb"), node(F.col("l_line"), F.col("l_at")).alias("a"), node(F.col("r_line"), F.col("r_at")).alias("b"), length.alias("length"))
    return least_connections(links, "length", joins=("ca", "cb"))


def assemble_graph(lines: DataFrame, connectors: DataFrame) -> DataFrame:
    """(a, b, length, kind): lines (line, length) cut at their ends and where connectors (a, b, length) meet them, and the connectors."""
    ends = lines.select("line", F.explode(F.array(F.lit(0).cast("long"), F.col("length").cast("long"))).alias("at"))
    met = connectors.select(F.explode(F.array("a", "b")).alias("n")).select(F.shiftright("n", 32).alias("line"), F.col("n").bitwiseAND(2**32 - 1).alias("at"))
    cuts = ends.unionByName(met.join(lines.select("line"), "line", "left_semi")).distinct()
    follow = F.lead("at").over(Window.partitionBy("line").orderBy("at"))
    pieces = cuts.withColumn("next", follow).where("next IS NOT NULL")
    made = pieces.select(node(F.col("line"), F.col("at")).alias("a"), node(F.col("line"), F.col("next")).alias("b"), (F.col("next") - F.col("at")).alias("length"), F.lit("line").alias("kind"))
    return made.unionByName(connectors.select("a", "b", F.col("length").cast("long").alias("length"), F.lit("connector").alias("kind")))


def merged_along(boxes: DataFrame) -> DataFrame:
    """Boxes that cover the same ground: those of one lower and upper edge that touch are one, so crowds and copies fold."""
    sides = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    b = boxes.select(*sides).dropna()
    plain = (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    w = Window.partitionBy("y0", "y1").orderBy("x0", "x1")
    one = b.where(plain).groupBy("y0", "y1", "x0").agg(F.max("x1").alias("x1"))
    new = F.col("x0") > F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = one.withColumn("new_", new).withColumn("run_", F.sum(F.coalesce(F.col("new_"), F.lit(True)).cast("int")).over(w))
    joined = joined.groupBy("y0", "y1", "run_").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return joined.select("x0", "y0", "x1", "y1").unionAll(b.where(~plain).distinct())


def outside_lengths(segments: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, length, outside): how much of each straight segment (x0, y0 to x1, y1) no box covers."""
    s = segments.select(F.col(key).alias("k"), F.col("x0").alias("sx"), F.col("y0").alias("sy"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    framed = s.withColumns({"x0": F.least("sx", "tx"), "y0": F.least("sy", "ty"), "x1": F.greatest("sx", "tx"), "y1": F.greatest("sy", "ty")})
    met = box_join(framed, merged_along(boxes))

    def clip(start: str, end: str, low: str, high: str) -> tuple[Column, Column]:
        """The share of the segment, from and to, within two parallel lines."""
        d = F.col(end) - F.col(start)
        a, b = (F.col(low) - F.col(start)) / d, (F.col(high) - F.col(start)) / d
        return F.when(d == 0, 0.0).otherwise(F.least(a, b)), F.when(d == 0, 1.0).otherwise(F.greatest(a, b))

    (ax, bx), (ay, by) = clip("l_sx", "l_tx", "r_x0", "r_x1"), clip("l_sy", "l_ty", "r_y0", "r_y1")
    spans = met.select(F.col("l_k").alias("k"), F.greatest(F.lit(0.0), ax, ay).alias("t0"), F.least(F.lit(1.0), bx, by).alias("t1")).where("t0 < t1")
    before = F.max("t1").over(Window.partitionBy("k").orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1))
    inside = spans.withColumn("from", F.greatest(F.col("t0"), F.coalesce(before, F.lit(0.0)))).where(F.col("from") < F.col("t1")).groupBy("k").agg(F.sum(F.col("t1") - F.col("from")).alias("share"))
    length = F.sqrt(F.pow(F.col("tx") - F.col("sx"), 2) + F.pow(F.col("ty") - F.col("sy"), 2))
    out = s.withColumn("length", length).join(inside, "k", "left")
    return out.select(F.col("k").alias(key), "length", (F.col("length") * (1 - F.coalesce("share", F.lit(0.0)))).alias("outside"))


def restrict_outside(edges: DataFrame, segments: DataFrame, boxes: DataFrame, key: str, *, most: float) -> DataFrame:
    """Edges without those whose segment runs more than ``most`` outside all boxes; edges without a segment stay."""
    far = outside_lengths(segments, boxes, key).where(F.col("outside") > most).select(key)
    return edges.join(far, key, "left_anti")
