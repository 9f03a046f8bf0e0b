"""Walks as tables: rings ranked by doubling, paths expanded by doubling, tours around trees, plans by policy.

``ring_positions`` doubles pointers until each item of a ring knows the least
item and how far ahead it is; rounds grow with the logarithm of the longest
ring. Shortest paths keep a table of the node before each node (ties: the least),
and ``expand_paths`` finds all nodes of all legs at once: jumps of 1, 2, 4, ...
nodes double the known end of every path. No graph, path or tour is ever in one
task or on the driver.

Edge lengths must be positive: along a path they fall strictly towards its start.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.operators.graph import adjacency, shortest_lengths
from fieldlark.operators.spanning import least_connections
from fieldlark.session import Steps


def ring_positions(links: DataFrame) -> DataFrame:
    """(item, ring, ahead): the least item of each ring and how many steps ahead it lies. links: (item, next), each item once on either side."""
    steps = Steps(links.sparkSession)
    ptr = steps.put("ptr", links.select("item", F.col("next").alias("ptr"), F.col("item").alias("low"), F.lit(0).cast("long").alias("off")))
    size = 1
    while True:  # low: the least of the ``size`` items from here on; off: how far ahead it is
        there = ptr.select(F.col("item").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("low_"), F.col("off").alias("off_"))
        less = F.col("low_") < F.col("low")
        moved = ptr.join(there, "ptr").select("item", F.col("far").alias("ptr"), F.least("low", "low_").alias("low"), F.when(less, F.col("off_") + size).otherwise(F.col("off")).alias("off"), less.alias("fell"))
        ptr = steps.put("ptr", moved)
        size *= 2
        if ptr.where("fell").isEmpty():
            return ptr.select("item", F.col("low").alias("ring"), F.col("off").alias("ahead"))


def predecessors(edges: DataFrame, sources: DataFrame, weight: str) -> DataFrame:
    """(source, node, dist, before): shortest distances, and the least node before each; none before the source."""
    if not edges.where(F.col(weight) <= 0).isEmpty():
        raise ValueError("edge lengths must be positive")
    best = shortest_lengths(edges, sources, weight)
    step = best.join(adjacency(edges, weight), best.node == F.col("a")).select("source", F.col("b").alias("node"), (F.col("dist") + F.col(weight)).alias("via"), F.col("a").alias("before"))
    found = best.join(step, ["source", "node"]).where(F.col("via") == F.col("dist")).groupBy("source", "node").agg(F.min("before").alias("before"))
    return best.join(found, ["source", "node"], "left").select("source", "node", "dist", "before")


def expand_paths(before: DataFrame, legs: DataFrame) -> DataFrame:
    """(leg, step, node, dist): the nodes of each leg's shortest path from a (step 0) to b; legs: (leg, a, b). Legs whose b can't be reached have no row."""
    steps = Steps(before.sparkSession)
    known = steps.put("known", before)
    jump = steps.put("jump", known.where("before IS NOT NULL").select("source", "node", F.col("before").alias("to")))
    path = steps.put("path", legs.join(known, (F.col("a") == F.col("source")) & (F.col("b") == F.col("node"))).select("leg", "source", "node", F.lit(0).cast("long").alias("off")))
    size = 1
    while True:
        new = steps.put("new", path.join(jump, ["source", "node"]).select("leg", "source", F.col("to").alias("node"), (F.col("off") + size).alias("off")))
        if new.isEmpty():
            break
        path = steps.put("path", path.unionAll(new))
        far = jump.select("source", F.col("node").alias("to"), F.col("to").alias("far"))
        jump = steps.put("jump", jump.join(far, ["source", "to"]).select("source", "node", F.col("far").alias("to")))
        size *= 2
    long = path.groupBy("leg").agg(F.max("off").alias("n"))
    return path.join(long, "leg").join(known.drop("before"), ["source", "node"]).select("leg", (F.col("n") - F.col("off")).alias("step"), "node", "dist")


def shortest_paths(edges: DataFrame, legs: DataFrame, weight: str) -> DataFrame:
    """(leg, step, node, dist) for legs (leg, a, b)."""
    return expand_paths(predecessors(edges, legs.select(F.col("a").alias("node")).distinct(), weight), legs)


def unroll(edges: DataFrame, stops: DataFrame, weight: str) -> DataFrame:
    """(tour, place, node, along, stops): the closed walk of each tour through its stops (tour, at, node), by shortest paths.

    place counts nodes from 0, a node that a stop repeats at once counting once;
    along is the length walked so far; stops holds ``at`` of those made there.
    Tours with a stop that can't be reached are left out.
    """
    order = Window.partitionBy("tour").orderBy("at")
    first = F.first("node").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    legs = stops.withColumn("b", F.coalesce(F.lead("node").over(order), first)).select("tour", F.col("at"), F.col("node").alias("a"), "b")
    steps = Steps(edges.sparkSession)
    legs = steps.put("legs", legs.withColumn("leg", F.monotonically_increasing_id()))
    paths = steps.put("paths", shortest_paths(edges, legs.select("leg", "a", "b"), weight))
    size = paths.groupBy("leg").agg(F.max("step").alias("n"), F.max("dist").alias("length"))
    whole = legs.join(size, "leg", "left")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    lost = F.count_if(F.col("n").isNull()).over(Window.partitionBy("tour"))
    placed = whole.select("tour", "at", "leg", lost.alias("lost"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("length").over(upto), F.lit(0)).alias("along0"))
    last = placed.groupBy("tour").agg(F.max("at").alias("last"))
    rows = paths.join(placed.where("lost = 0").join(last, "tour"), "leg")
    longest = F.max("step").over(Window.partitionBy("leg"))
    rows = rows.withColumn("longest", longest).where((F.col("step") < F.col("longest")) | (F.col("at") == F.col("last")))
    walk = rows.select("tour", (F.col("n0") + F.col("step")).alias("place"), "node", (F.col("along0") + F.col("dist")).alias("along"))
    held = placed.groupBy("tour", F.col("n0").alias("place")).agg(F.sort_array(F.collect_list("at")).alias("stops"))
    return walk.join(held, ["tour", "place"], "left")


def tree_tour(tree: DataFrame, start: Column) -> DataFrame:
    """(node, visit): nodes of a tree (a, b) in the order in which a walk around it from ``start`` first meets them.

    The walk takes each edge once each way, first that to the least neighbour of
    ``start``; after (u, v) comes the edge from v to its next neighbour after u, in
    rising order, or to its first.
    """
    both = tree.select("a", "b").unionAll(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
    steps = Steps(tree.sparkSession)
    around = Window.partitionBy("a").orderBy("b")
    firsts = F.first("b").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ways = steps.put("ways", both.withColumn("then", F.coalesce(F.lead("b").over(around), firsts)).withColumn("item", F.monotonically_increasing_id()))
    links = ways.select("item", F.col("a").alias("u"), F.col("b").alias("v")).join(ways.select(F.col("a").alias("v"), F.col("b").alias("u"), "then"), ["u", "v"])
    nexts = links.join(ways.select(F.col("a").alias("v"), F.col("b").alias("then"), F.col("item").alias("next")), ["v", "then"]).select("item", "next")
    ranked = steps.put("ranked", ways.join(ring_positions(nexts), "item"))
    size = ranked.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    at = ranked.join(size, "ring").withColumn("at", F.col("n") - F.col("ahead"))  # 1 .. n from the ring's least item on
    head = at.where(F.col("a") == start).groupBy("ring").agg(F.min_by(F.pmod("at", "n"), "b").alias("head"))
    met = at.join(head, "ring").select("b", F.pmod(F.col("at") - F.col("head"), F.col("n")).alias("visit")).where(F.col("b") != start)
    seen = met.groupBy(F.col("b").alias("node")).agg((F.min("visit") + 1).alias("visit"))
    return seen.unionByName(head.select(start.alias("node"), F.lit(0).cast("long").alias("visit")))


def plan_tour(edges: DataFrame, stops: DataFrame, weight: str, start: int) -> DataFrame:
    """(at, node, to, dist): stops in the order of a walk around the least tree over their distances (at most twice the shortest tour where lengths fulfil the triangle rule), back to the start; stops: (node)."""
    steps = Steps(edges.sparkSession)
    far = shortest_lengths(edges, stops, weight)
    far = steps.put("far", far.join(stops.select("node"), "node", "left_semi"))
    tree = steps.put("tree", least_connections(far.where("source < node").select(F.col("source").alias("a"), F.col("node").alias("b"), "dist"), "dist"))
    order = tree_tour(tree, F.lit(start).cast(stops.schema["node"].dataType))
    seq = steps.put("seq", _numbered(order))
    after = seq.select((F.col("at") - 1).alias("at"), F.col("node").alias("to"))
    seq = seq.join(after, "at", "left").select("at", "node", F.coalesce("to", F.lit(start)).alias("to"))
    return seq.join(far.select(F.col("source").alias("node"), F.col("node").alias("to"), "dist"), ["node", "to"]).select("at", "node", "to", "dist")


def _numbered(order: DataFrame) -> DataFrame:
    """(at, node): 0, 1, ... by visit; visits are counted per range first, so no task sorts all."""
    ranged = order.withColumn("range", F.floor(F.col("visit") / 4096))
    per = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row per 4,096 visits
    number = F.row_number().over(Window.partitionBy("range").orderBy("visit")) - 1 + F.col("before")
    return ranged.join(before, "range").select(number.alias("at"), "node")


def plan_route(edges: DataFrame, stops: DataFrame, weight: str, start: int, policies: Mapping[str, Column]) -> DataFrame:
    """(policy, n_stops, length, chosen): a tour per policy, a condition on edges that may be walked; chosen: most stops, then the shortest, then the first named."""
    out = None
    for k, (name, allowed) in enumerate(policies.items()):
        plan = plan_tour(edges.where(allowed), stops, weight, start).agg(F.count(F.lit(1)).alias("n_stops"), F.coalesce(F.sum("dist"), F.lit(0)).alias("length")).select(F.lit(name).alias("policy"), F.lit(k).alias("k"), "n_stops", "length")
        out = plan if out is None else out.unionByName(plan)
    out = Steps(edges.sparkSession).put("plans", out)
    rank = F.row_number().over(Window.orderBy(F.col("n_stops").desc(), "length", "k"))
    return out.select("policy", "n_stops", "length", (rank == 1).alias("chosen"))
