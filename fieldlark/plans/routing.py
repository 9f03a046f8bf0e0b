"""Queries of paths, walks and tours over the roads between nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators import routes as R

from .registry import Tables, query
from .structural import _LENGTHS, _roads

_WAYS = "SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM (SELECT c_nationkey::BIGINT AS a, c_custkey % 25 AS b, 1 + c_custkey % 9 AS w FROM customer) WHERE a <> b GROUP BY 1, 2"
_PATHS = f"""far AS ({_LENGTHS}), ways AS ({_WAYS}), adj AS (SELECT a, b, w FROM ways UNION ALL SELECT b, a, w FROM ways),
before AS (SELECT f.source, f.node, min(g.node) AS back FROM far f JOIN adj ON adj.b = f.node JOIN far g ON g.source = f.source AND g.node = adj.a AND g.dist + adj.w = f.dist GROUP BY 1, 2),
walk(leg, source, node, off) AS (SELECT leg, a, b, 0 FROM legs UNION ALL SELECT leg, w.source, back, off + 1 FROM walk w JOIN before b ON b.source = w.source AND b.node = w.node),
path AS (SELECT leg, max(off) OVER (PARTITION BY leg) - off AS step, w.node, dist FROM walk w JOIN far USING (source, node))"""


@query("leg_paths", f"WITH RECURSIVE legs AS (SELECT s_suppkey AS leg, s_nationkey::BIGINT AS a, (s_suppkey * 11) % 25 AS b FROM supplier), {_PATHS} SELECT leg, step, node, dist FROM path")
def leg_paths(t: Tables) -> DataFrame:
    """All nodes of the shortest path of each leg, ties to the least node before."""
    legs = t.supplier.select(F.col("s_suppkey").alias("leg"), F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") * 11 % 25).alias("b"))
    return R.shortest_paths(_roads(t), legs, "w")


@query(
    "unrolled_tours",
    f"""WITH RECURSIVE stops AS (SELECT s_suppkey // 10 AS tour, s_suppkey % 10 AS pos, s_nationkey::BIGINT AS node FROM supplier),
legs AS (SELECT tour * 10 + pos AS leg, tour, pos, node AS a, coalesce(lead(node) OVER w, first_value(node) OVER w) AS b FROM stops WINDOW w AS (PARTITION BY tour ORDER BY pos)), {_PATHS},
size AS (SELECT leg, max(step) AS n, max(dist) AS length FROM path GROUP BY leg),
placed AS (SELECT *, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(length) OVER w, 0) AS along0, max(pos) OVER (PARTITION BY tour) AS last FROM legs JOIN size USING (leg) WINDOW w AS (PARTITION BY tour ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT tour, CAST(n0 + step AS BIGINT) AS place, path.node, CAST(along0 + dist AS BIGINT) AS along FROM path JOIN placed USING (leg) WHERE step < n OR pos = last""",
)
def unrolled_tours(t: Tables) -> DataFrame:
    """The closed walk of every ten suppliers' nations in order."""
    k = F.col("s_suppkey")
    stops = t.supplier.select(F.floor(k / 10).alias("tour"), (k % 10).alias("at"), F.col("s_nationkey").cast("long").alias("node"))
    return R.unroll(_roads(t), stops, "w").drop("stops")


@query(
    "route_plan",
    f"""WITH RECURSIVE far AS ({_LENGTHS}), e AS (SELECT source AS p, node AS q, least(source, node) AS a, greatest(source, node) AS b, dist AS w FROM far WHERE source <> node),
t(n, seen, a, b, w) AS (SELECT 1, [0::BIGINT], 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
SELECT n + 1, list_append(seen, x.q), x.a, x.b, x.w FROM (SELECT t.n, t.seen, arg_min(struct_pack(q := e.q, a := e.a, b := e.b, w := e.w), struct_pack(w := e.w, a := e.a, b := e.b)) AS x
FROM t JOIN e ON list_contains(t.seen, e.p) AND NOT list_contains(t.seen, e.q) GROUP BY t.n, t.seen)),
tree AS (SELECT a, b FROM t WHERE n > 1 UNION ALL SELECT b, a FROM t WHERE n > 1),
ranked AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS k, count(*) OVER (PARTITION BY a) AS deg FROM tree),
met(node, back, key) AS (SELECT 0::BIGINT, -1::BIGINT, [0::BIGINT] UNION ALL
SELECT r.b, r.a, list_append(m.key, CASE WHEN p.k IS NULL THEN r.k ELSE (r.k - p.k + r.deg) % r.deg END) FROM met m JOIN ranked r ON r.a = m.node AND r.b <> m.back LEFT JOIN ranked p ON p.a = m.node AND p.b = m.back),
seq AS (SELECT row_number() OVER (ORDER BY key) - 1 AS at_, node, coalesce(lead(node) OVER (ORDER BY key), 0) AS dest FROM met)
SELECT at_ AS "at", seq.node, dest AS "to", dist FROM seq JOIN far ON far.source = seq.node AND far.node = dest""",
)
def route_plan(t: Tables) -> DataFrame:
    """All nations in the order of a walk around the least tree over their distances."""
    return R.plan_tour(_roads(t), t.nation.select(F.col("n_nationkey").cast("long").alias("node")), "w", 0)
