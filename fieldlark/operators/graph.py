"""Graphs as edge tables: components, adjacency, distances, tours.

Components and relaxations are loops of joins over written tables; walks are in
``routes``. The tour kernels at the end work on the distances of one group's few
stops.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldlark.session import Steps


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable. edges: (a, b); nodes: (node) to name isolated ones too.

    Alternating stars: links (a, b), a > b, are first moved so that every node
    hands its larger neighbours to the least one it knows, then so that its
    smaller neighbours hang on their least; last, the links that meet in one
    partition are made stars there. All keep what is connected; rounds grow with
    the logarithm of the graph's length at most and end when each node hangs on
    the least of its component. Least nodes are tables of their own, so both
    sides of a join are plain shuffles (asked for: files are small for their rows,
    and nothing goes through the driver) and the engine's skew join can split a hub.
    """
    steps = Steps(edges.sparkSession)
    every = steps.put("edges", edges.select("a", "b"))
    links = steps.put("links", _local_stars(every.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    while True:
        low = steps.put("low", links.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")))
        up = low.select(F.col("a").alias("b"), "low")
        if low.where("n > 1").isEmpty() and links.join(up.hint("merge"), "b", "left_semi").isEmpty():
            break
        large = steps.put("large", links.join(up.hint("merge"), "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct())
        low = steps.put("low", large.groupBy("a").agg(F.min("b").alias("low")))
        side = large.join(low.hint("merge"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = steps.put("links", _local_stars(side.union(low.select("a", F.col("low").alias("b"))).distinct()))
    known = every.select(F.col("a").alias("node")).union(every.select("b")).distinct() if nodes is None else nodes.select("node")
    return known.join(links.withColumnsRenamed({"a": "node", "b": "component"}).hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _local_stars(links: DataFrame) -> DataFrame:
    """Each partition's links (a, b), every node on the least it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema) if (batches := list(batches)) else None
        if table is None:
            return
        a, b = (table.column(i).combine_chunks() for i in (0, 1))
        names, at = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (a, b)]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        label = least_reached(a, b, len(names))
        moved = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved], schema.types[0]), pa.array(names[label[moved]], schema.types[1])], schema=schema)

    schema = to_arrow_schema(links.schema)
    return links.mapInArrow(run, links.schema)


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of nodes 0 to n - 1 that each reaches over links (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        for x, y in ((a, b), (b, a)):
            np.minimum.at(low, label[x], label[y])
            np.minimum.at(low, x, label[y])
        while (low != (jump := low[low])).any():
            low = jump
        if (low == label).all():
            return label
        label = low


def adjacency(edges: DataFrame, weight: str) -> DataFrame:
    """(a, b, weight) both ways, parallel edges to the least weight, no loops."""
    one = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(weight).alias(weight))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), weight))


def component_report(labels: DataFrame, edges: DataFrame, weight: str, start: int | None = None) -> DataFrame:
    """Nodes, edges and length of each component, the one with ``start`` first, then by length."""
    n = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.max((F.col("node") == F.lit(start)).cast("int")).alias("has_start"))
    e = edges.join(labels, edges.a == labels.node).groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(weight).alias("length"))
    return n.join(e, "component", "left").select("component", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("has_start", F.lit(0)).alias("has_start"))


def shortest_lengths(edges: DataFrame, sources: DataFrame, weight: str, *, most_rounds: int = 10_000) -> DataFrame:
    """(source, node, dist): rounds of relaxation from all sources at once; only labels that fell go on."""
    steps = Steps(edges.sparkSession)
    adj = steps.put("adjacency", adjacency(edges, weight))
    zero = F.lit(0).cast(edges.schema[weight].dataType)
    best = steps.put("best", sources.select(F.col("node").alias("source"), "node", zero.alias("dist"), F.lit(True).alias("fell")).distinct())
    for _ in range(most_rounds):
        front = best.where("fell")
        step = front.join(adj, front.node == adj.a).groupBy("source", "b").agg(F.min(F.col("dist") + F.col(weight)).alias("new")).select("source", F.col("b").alias("node"), "new")
        fell = F.col("dist").isNull() | F.coalesce(F.col("new") < F.col("dist"), F.lit(False))
        best = steps.put("best", best.drop("fell").join(step, ["source", "node"], "full_outer").select("source", "node", F.least("dist", "new").alias("dist"), fell.alias("fell")))
        if best.where("fell").isEmpty():
            return best.drop("fell")
    raise RuntimeError("distances still fall after the most rounds")


def distance_matrix(edges: DataFrame, sources: DataFrame, weight: str) -> DataFrame:
    """(source, node, dist) of all nodes reachable from the sources (node)."""
    return shortest_lengths(edges, sources.select(F.col("node").cast("long")), weight).select("source", "node", F.col("dist").cast("double").alias("dist"))


def contract(edges: Sequence[tuple[int, int, float]], keep: set[int]) -> list[tuple[int, int, float]]:
    """Edges with nodes of two neighbours drawn out of chains, but for those to keep."""
    adj: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                adj.setdefault(x, {})[y] = min(w, adj.get(x, {}).get(y, np.inf))
    for n in sorted(adj):
        if n not in keep and len(adj[n]) == 2:
            (p, wp), (q, wq) = adj.pop(n).items()
            del adj[p][n], adj[q][n]
            w = min(wp + wq, adj[p].get(q, np.inf))
            adj[p][q] = adj[q][p] = w
    return sorted((a, b, w) for a in adj for b, w in adj[a].items() if a < b)


# --- tours -------------------------------------------------------------------------------------------------


def tour_length(d: np.ndarray, tour: Sequence[int]) -> float:
    return float(sum(d[a, b] for a, b in zip(tour, [*tour[1:], tour[0]])))


def nearest_neighbour_tour(d: np.ndarray) -> list[int]:
    """From node 0 to the nearest node left, ties to the lowest."""
    left, tour = set(range(1, len(d))), [0]
    while left:
        tour.append(min(left, key=lambda j: (d[tour[-1], j], j)))
        left.remove(tour[-1])
    return tour


def improve_tour(d: np.ndarray, tour: list[int], sweeps: int = 20) -> list[int]:
    """2-opt and moves of up to three stops by best change of length, a fixed number of sweeps (no clock), node 0 first; symmetric distances."""
    t, n = np.array(tour), len(tour)
    for _ in range(sweeps):
        better = False
        for i in range(1, n - 1):
            j = np.arange(i + 1, n)
            a, b, c, e = t[i - 1], t[i], t[j], t[(j + 1) % n]
            change = d[a, c] + d[b, e] - d[a, b] - d[c, e]
            k = int(change.argmin())
            if change[k] < -1e-12:
                t[i : j[k] + 1] = t[i : j[k] + 1][::-1].copy()
                better = True
        for size in (1, 2, 3):
            for i in range(1, n - size + 1):
                part, rest = t[i : i + size], np.concatenate((t[:i], t[i + size :]))
                if len(rest) < 2:
                    continue
                p, q = t[i - 1], t[(i + size) % n]
                gain = d[p, part[0]] + d[part[-1], q] - d[p, q]
                u, v = rest, np.roll(rest, -1)
                cost = d[u, part[0]] + d[part[-1], v] - d[u, v]
                k = int(cost.argmin())
                if cost[k] < gain - 1e-12:
                    t = np.concatenate((rest[: k + 1], part, rest[k + 1 :]))
                    better = True
        if not better:
            break
    return t.tolist()


def exact_group_tour(d: np.ndarray, groups: Sequence[Sequence[int]]) -> tuple[float, list[int]]:
    """Shortest closed tour from node 0 through one node of each group, by dynamic programming over sets of groups."""
    n = len(groups)
    if not n:
        return 0.0, [0]
    best: dict[tuple[int, int], tuple[float, int | None]] = {(1 << g, v): (float(d[0, v]), None) for g, nodes in enumerate(groups) for v in nodes}
    for size in range(2, n + 1):
        for sub in itertools.combinations(range(n), size):
            mask = sum(1 << g for g in sub)
            for g in sub:
                before = mask ^ (1 << g)
                for v in groups[g]:
                    options = [(best[before, u][0] + float(d[u, v]), u) for h in sub if h != g for u in groups[h]]
                    best[mask, v] = min(options)
    full = (1 << n) - 1
    total, v = min((best[full, v][0] + float(d[v, 0]), v) for nodes in groups for v in nodes)
    path, mask = [], full
    while v is not None:
        path.append(v)
        u = best[mask, v][1]
        mask ^= next(1 << g for g, nodes in enumerate(groups) if v in nodes)
        v = u
    return total, [0, *path[::-1]]


def group_tour(d: np.ndarray, groups: Sequence[Sequence[int]], *, exact_up_to: int = 8, sweeps: int = 20) -> tuple[float, list[int]]:
    """One node of each group on a short closed tour: exact for few groups, else insertion, 2-opt and node swaps."""
    if len(groups) <= exact_up_to:
        return exact_group_tour(d, groups)
    tour = [0]
    left = dict(enumerate(groups))
    while left:  # cheapest insertion
        _, g, v, k = min((d[tour[k - 1], v] + d[v, tour[k % len(tour)]] - (d[tour[k - 1], tour[k % len(tour)]] if len(tour) > 1 else 0), g, v, k) for g, nodes in left.items() for v in nodes for k in range(1, len(tour) + 1))
        tour.insert(k, v)
        del left[g]
    of = {v: g for g, nodes in enumerate(groups) for v in nodes}
    for _ in range(sweeps):
        before = tour_length(d, tour)
        tour = improve_tour(d, tour, 1)
        for k in range(1, len(tour)):
            a, b = tour[k - 1], tour[(k + 1) % len(tour)]
            tour[k] = min(groups[of[tour[k]]], key=lambda v: (d[a, v] + d[v, b], v))
        if tour_length(d, tour) >= before - 1e-12:
            break
    return tour_length(d, tour), tour


def insertion_costs(d: np.ndarray, tour: Sequence[int], groups: Sequence[Sequence[int]]) -> list[float]:
    """Least detour that visits each group from the tour."""
    legs = list(zip(tour, [*tour[1:], tour[0]]))
    return [min(float(d[a, v] + d[v, b] - d[a, b]) for v in nodes for a, b in legs) for nodes in groups]
