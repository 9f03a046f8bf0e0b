"""Queries of adaptive joins, outlines, masks, connectors and walking graphs, on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators import labelling as L
from fieldlark.operators import outlines as O
from fieldlark.operators import row_votes as V
from fieldlark.operators import skeletons as K
from fieldlark.operators import spanning as S
from fieldlark.operators import unions as U
from fieldlark.operators.derive import derive
from fieldlark.operators.quadtree import adaptive_box_join

from .registry import Tables, query

# --- boxes a third of which lie in one thousandth of the plane ---------------------------------------------

_CROWDED = """SELECT k, CASE WHEN k % 3 = 0 THEN 5000 + k * {a} % 997 ELSE k * {b} % 1000003 END AS x0, CASE WHEN k % 3 = 0 THEN 7000 + k * {c} % 991 ELSE k * {d} % 999983 END AS y0,
CASE WHEN k % 3 = 0 THEN {small} + k % 5 ELSE 9000 + k % 4000 END AS w FROM (SELECT {key} AS k FROM {table})"""
_LEFT = _CROWDED.format(a=7919, b=611953, c=104729, d=746773, small=8, key="p_partkey", table="part")
_RIGHT = _CROWDED.format(a=6151, b=350377, c=49157, d=224737, small=12, key="c_custkey", table="customer")


def _crowded(df: DataFrame, key: str, a: int, b: int, c: int, d: int, small: int) -> DataFrame:
    k = F.col(key)
    x, y = F.when(k % 3 == 0, 5000 + k * a % 997).otherwise(k * b % 1000003), F.when(k % 3 == 0, 7000 + k * c % 991).otherwise(k * d % 999983)
    w = F.when(k % 3 == 0, small + k % 5).otherwise(9000 + k % 4000)
    return df.select(k.alias("k"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + w).alias("y1"))


@query("crowded_box_pairs", f"SELECT l.k AS l, r.k AS r FROM ({_LEFT}) l JOIN ({_RIGHT}) r ON l.x0 <= r.x0 + r.w AND r.x0 <= l.x0 + l.w AND l.y0 <= r.y0 + r.w AND r.y0 <= l.y0 + l.w")
def crowded_box_pairs(t: Tables) -> DataFrame:
    """By quadtree cells: a grid would put a third of all boxes in one."""
    left, right = _crowded(t.part, "p_partkey", 7919, 611953, 104729, 746773, 8), _crowded(t.customer, "c_custkey", 6151, 350377, 49157, 224737, 12)
    return adaptive_box_join(left, right, most=500).select(F.col("l_k").alias("l"), F.col("r_k").alias("r"))


# --- outlines: the SQL paints unit cells -------------------------------------------------------------------

_SHEET = "SELECT p_partkey % 13 AS g, p_partkey * 37 % 97 AS x0, p_partkey * 101 % 89 + 100 * (p_partkey // 2000) AS y0, 1 + p_size % 9 AS w, 1 + p_partkey % 7 AS h FROM part"
_HOLE = "SELECT s_suppkey % 13 AS g, s_suppkey * 41 % 97 AS x0, s_suppkey * 29 % 89 + 100 * (s_suppkey // 100) AS y0, 2 + s_suppkey % 5 AS w, 3 AS h FROM supplier"


def _sheets(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    x, y = k * 37 % 97, k * 101 % 89 + 100 * F.floor(k / 2000)
    return t.part.select((k % 13).alias("g"), x.alias("x0"), y.alias("y0"), (x + 1 + F.col("p_size") % 9).alias("x1"), (y + 1 + k % 7).alias("y1"))


def _holes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k * 41 % 97, k * 29 % 89 + 100 * F.floor(k / 100)
    return t.supplier.select((k % 13).alias("g"), x.alias("x0"), y.alias("y0"), (x + 2 + k % 5).alias("x1"), (y + 3).alias("y1"))


def _paint(boxes: str, by: int = 0) -> str:
    return f"SELECT DISTINCT g, x, unnest(range(y0 - {by}, y0 + h + {by})) AS y FROM (SELECT g, y0, h, unnest(range(x0 - {by}, x0 + w + {by})) AS x FROM ({boxes}))"


def _erode(cells: str, by: int) -> str:
    around = f"(SELECT i, j FROM range(-{by}, {by} + 1) a(i), range(-{by}, {by} + 1) b(j))"
    return f"SELECT c.g, c.x, c.y FROM {cells} c, {around} o JOIN {cells} d ON d.g = c.g AND d.x = c.x + o.i AND d.y = c.y + o.j GROUP BY ALL HAVING count(*) = {(2 * by + 1) ** 2}"


_SIZES = """SELECT g, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - n) AS DOUBLE) AS length FROM (
SELECT c.g, c.x, c.y, count(d.g) AS n FROM {cells} c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j) LEFT JOIN {cells} d ON d.g = c.g AND d.x = c.x + o.i AND d.y = c.y + o.j GROUP BY ALL) GROUP BY g"""


def _sizes(edges: DataFrame) -> DataFrame:
    return O.measures(edges, "g").select("g", "area", "length")


@query("outline", f"WITH cells AS ({_paint(_SHEET)}) {_SIZES.format(cells='cells')}")
def outline(t: Tables) -> DataFrame:
    """Area and edge length of the union of each group's boxes."""
    return _sizes(O.boundary(_sheets(t), "g"))


@query(
    "outline_rings",
    f"""WITH cells AS ({_paint(_SHEET)} EXCEPT {_paint(_HOLE)}),
corners AS (SELECT g, x + i AS vx, y + j AS vy, count(*) AS n, sum(i * 2 + j) AS s FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) GROUP BY ALL)
SELECT g, CAST(sum(CASE WHEN n = 1 OR n = 3 THEN 1 WHEN n = 2 AND s = 3 THEN 2 ELSE 0 END) AS BIGINT) AS n_corners,
CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND s = 3 THEN 2 ELSE 0 END) // 4 AS BIGINT) AS outlines_less_holes,
(SELECT CAST(count(*) AS DOUBLE) FROM cells c WHERE c.g = corners.g) AS area FROM corners GROUP BY g""",
)
def outline_rings(t: Tables) -> DataFrame:
    """Rings around each group's boxes without its holes; the SQL counts convex and concave corners."""
    rings = O.trace(O.boundary(_sheets(t), "g", minus=_holes(t)), "g")
    sign = F.when(F.col("area") > 0, 1).otherwise(-1)
    return rings.groupBy("g").agg(F.sum(F.size("corners")).alias("n_corners"), F.sum(sign).alias("outlines_less_holes"), F.sum("area").alias("area"))


@query("closed_outline", f"WITH big AS ({_paint(_SHEET, 1)}), cells AS ({_erode('big', 1)}) {_SIZES.format(cells='cells')}")
def closed_outline(t: Tables) -> DataFrame:
    """The closing of each block's objects, which grows them together and shrinks the whole."""
    return _sizes(O.outline_of(_sheets(t), "g", reach=1.0, lone_reach=1.0))


@query(
    "walk_domain",
    f"""WITH big AS ({_paint(_SHEET, 1)}), ground AS ({_erode('big', 1)} EXCEPT {_paint(_HOLE)}), inner_ AS ({_erode('ground', 1)})
SELECT 0.0::DOUBLE AS margin, * FROM ({_SIZES.format(cells='ground')}) UNION ALL SELECT 1.0::DOUBLE, * FROM ({_SIZES.format(cells='inner_')})""",
)
def walk_domain(t: Tables) -> DataFrame:
    """Closed ground without what is barred, and a copy eroded by a margin."""
    edges = O.walkable(_sheets(t), _holes(t), "g", reach=1.0, margins=(1.0,))
    return edges.groupBy("margin", "g").agg(F.sum(F.col("x0") * (F.col("y1") - F.col("y0"))).alias("area"), F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).alias("length"))


# --- masks: the SQL floods by recursion --------------------------------------------------------------------

_MASK = "SELECT DISTINCT (p_partkey * 37 + p_partkey // 13) % 97 AS x, (p_partkey * 17 + p_partkey // 11) % 50 + 50 * (p_partkey // 2000) AS y FROM part"
_CORRIDOR = "SELECT s_suppkey AS c, s_suppkey % 10 * 10 AS x0, s_suppkey // 10 * 8 AS y0 FROM supplier"


def _runs(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return L.pixel_runs(t.part.select(((k * 37 + F.floor(k / 13)) % 97).alias("x"), ((k * 17 + F.floor(k / 11)) % 50 + 50 * F.floor(k / 2000)).alias("y")))


def _flood(mask: str, key: str = "") -> str:
    k, r = (f"{key}, ", f"r.{key}, ") if key else ("", "")
    same = f" AND p.{key} = r.{key}" if key else ""
    return f"""WITH RECURSIVE p AS ({mask}),
r({k}x, y, fx, fy) AS (SELECT {k}x, y, x, y FROM p UNION SELECT {r}p.x, p.y, r.fx, r.fy FROM r, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j) JOIN p ON p.x = r.x + o.i AND p.y = r.y + o.j{same}),
f AS (SELECT {k}x, y, min(fy * 1000000 + fx) AS first FROM r GROUP BY ALL)
SELECT {k}first // 1000000 AS first_y, first % 1000000 AS first_x, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM f GROUP BY {k}first"""


@query("mask_places", _flood(_MASK))
def mask_places(t: Tables) -> DataFrame:
    """Connected places of a mask, by runs."""
    return L.places(L.label_runs(_runs(t))).drop("place")


@query("corridor_crowns", _flood(f"SELECT c, x, y FROM ({_MASK}) JOIN ({_CORRIDOR}) ON x >= x0 AND x < x0 + 8 AND y >= y0 AND y < y0 + 7", "c") + " HAVING count(*) >= 3")
def corridor_crowns(t: Tables) -> DataFrame:
    """Places of the mask within corridors, of three pixels or more."""
    k = F.col("s_suppkey")
    boxes = t.supplier.select(k.alias("c"), (k % 10 * 10).alias("x0"), (F.floor(k / 10) * 8).alias("y0"), (k % 10 * 10 + 8).alias("x1"), (F.floor(k / 10) * 8 + 7).alias("y1"))
    return L.corridor_places(_runs(t), boxes, "c", least=3)[1].drop("place")


@query(
    "mask_outlines",
    f"""WITH p AS ({_MASK}), corners AS (SELECT x + i AS vx, y + j AS vy, count(*) AS n, sum(i * 2 + j) AS s FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) GROUP BY ALL)
SELECT (SELECT CAST(count(*) AS DOUBLE) FROM p) AS area, CAST(sum(CASE WHEN n = 1 OR n = 3 THEN 1 WHEN n = 2 AND s = 3 THEN 2 ELSE 0 END) AS BIGINT) AS n_corners,
CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND s = 3 THEN 2 ELSE 0 END) // 4 AS BIGINT) AS outlines_less_holes FROM corners""",
)
def mask_outlines(t: Tables) -> DataFrame:
    """Rings around all places of the mask, summed."""
    rings = L.place_outlines(L.label_runs(_runs(t)))
    return rings.agg(F.sum("area").alias("area"), F.sum(F.size("corners")).alias("n_corners"), F.sum(F.when(F.col("area") > 0, 1).otherwise(-1)).alias("outlines_less_holes"))


# --- least connections: the SQL grows one tree -------------------------------------------------------------

_ROADS = """SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM (
SELECT l_suppkey AS a, 1 + (l_suppkey * 7 + l_partkey) % (SELECT count(*) FROM supplier) AS b, l_partkey % 997 + l_quantity::BIGINT AS w FROM lineitem
UNION ALL SELECT s_suppkey, s_suppkey + 1, 5000 + s_suppkey FROM supplier WHERE s_suppkey < (SELECT max(s_suppkey) FROM supplier)) WHERE a <> b GROUP BY 1, 2"""


@query(
    "least_connections",
    f"""WITH RECURSIVE e AS (SELECT a AS p, b AS q, a, b, w FROM ({_ROADS}) UNION ALL SELECT b, a, a, b, w FROM ({_ROADS})),
t(n, seen, a, b, w) AS (SELECT 1, [1], 0, 0, 0 UNION ALL
SELECT n + 1, list_append(seen, x.q), x.a, x.b, x.w FROM (SELECT t.n, t.seen, arg_min(struct_pack(q := e.q, a := e.a, b := e.b, w := e.w), struct_pack(w := e.w, a := e.a, b := e.b)) AS x
FROM t JOIN e ON list_contains(t.seen, e.p) AND NOT list_contains(t.seen, e.q) GROUP BY t.n, t.seen))
SELECT a, b, w FROM t WHERE n > 1""",
)
def least_connections(t: Tables) -> DataFrame:
    """The links that join all suppliers at least cost."""
    n = t.supplier.count()
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    made = t.lineitem.select(s.alias("a"), (1 + (s * 7 + p) % n).alias("b"), (p % 997 + F.col("l_quantity").cast("long")).alias("w"))
    row = t.supplier.where(F.col("s_suppkey") < n).select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"), (5000 + F.col("s_suppkey")).alias("w"))
    return S.least_connections(made.unionByName(row), "w")


_LINES = "SELECT s_suppkey AS line, s_suppkey * 7 % 20 * 3 AS x, s_suppkey * 3 AS y, 20000 + s_suppkey % 9 * 1000 AS length FROM supplier"
_STOPS = f"SELECT line, pos, x + pos / 1000 AS x, y FROM (SELECT *, unnest([0, length // 2, length]) AS pos FROM ({_LINES}))"


def _lines(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("line"), (k * 7 % 20 * 3).alias("x"), (k * 3).alias("y"), (20000 + k % 9 * 1000).alias("length"))


def _walk_graph(t: Tables) -> DataFrame:
    lines = _lines(t)
    at = F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("length") / 2), F.col("length")))
    stops = lines.select("line", "x", "y", at.alias("at")).select("line", "at", (F.col("x") + F.col("at") / 1000).alias("x"), F.col("y").cast("double").alias("y"))
    return S.assemble_graph(lines, S.plan_connectors(stops, reach=75.0))


@query(
    "walk_graph",
    f"""WITH RECURSIVE s AS ({_STOPS}),
e AS (SELECT l.line AS p, r.line AS q, least(l.line, r.line) * 4294967296 + CASE WHEN l.line < r.line THEN l.pos ELSE r.pos END AS a, greatest(l.line, r.line) * 4294967296 + CASE WHEN l.line < r.line THEN r.pos ELSE l.pos END AS b,
  CAST(floor(sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) * 1000 + 0.5) AS BIGINT) AS w FROM s l JOIN s r ON l.line <> r.line AND pow(l.x - r.x, 2) + pow(l.y - r.y, 2) <= 75 * 75),
t(n, seen, a, b, w) AS (SELECT 1, [1], 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
SELECT n + 1, list_append(seen, x.q), x.a, x.b, x.w FROM (SELECT t.n, t.seen, arg_min(struct_pack(q := e.q, a := e.a, b := e.b, w := e.w), struct_pack(w := e.w, a := e.a, b := e.b)) AS x
FROM t JOIN e ON list_contains(t.seen, e.p) AND NOT list_contains(t.seen, e.q) GROUP BY t.n, t.seen)),
c AS (SELECT a, b, w FROM t WHERE n > 1),
cuts AS (SELECT line, 0 AS pos FROM ({_LINES}) UNION SELECT line, length FROM ({_LINES}) UNION SELECT a // 4294967296, a % 4294967296 FROM c UNION SELECT b // 4294967296, b % 4294967296 FROM c),
pieces AS (SELECT line, pos, lead(pos) OVER (PARTITION BY line ORDER BY pos) AS next FROM cuts)
SELECT line * 4294967296 + pos AS a, line * 4294967296 + next AS b, next - pos AS length, 'line' AS kind FROM pieces WHERE next IS NOT NULL UNION ALL SELECT a, b, w, 'connector' FROM c""",
)
def walk_graph(t: Tables) -> DataFrame:
    """Lines cut where the fewest, shortest connectors meet them."""
    return _walk_graph(t)


@query(
    "outside_lengths",
    """WITH s AS (SELECT c_custkey AS k, (c_custkey * 31 % 211)::DOUBLE AS x, (c_custkey * 17 % 199)::DOUBLE AS y, 4 + c_custkey % 60 AS n, c_custkey % 2 = 0 AS flat FROM customer),
b AS (SELECT s_suppkey * 7 % 200 AS x0, s_suppkey * 13 % 190 AS y0, s_suppkey * 7 % 200 + 9 + s_suppkey % 7 AS x1, s_suppkey * 13 % 190 + 8 AS y1 FROM supplier),
unit AS (SELECT k, x, y, n, flat, unnest(range(n)) AS i FROM s),
hit AS (SELECT DISTINCT k, i FROM unit JOIN b ON CASE WHEN flat THEN x + i >= x0 AND x + i < x1 AND y >= y0 AND y <= y1 ELSE y + i >= y0 AND y + i < y1 AND x >= x0 AND x <= x1 END)
SELECT k, CAST(n AS BIGINT) AS length, CAST(n - (SELECT count(*) FROM hit WHERE hit.k = s.k) AS BIGINT) AS outside FROM s""",
)
def outside_lengths(t: Tables) -> DataFrame:
    """How much of flat and upright segments no box covers; the SQL counts unit steps."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    x, y, n = (k * 31 % 211).cast("double"), (k * 17 % 199).cast("double"), 4 + k % 60
    flat = k % 2 == 0
    segments = t.customer.select(k.alias("k"), x.alias("x0"), y.alias("y0"), F.when(flat, x + n).otherwise(x).alias("x1"), F.when(flat, y).otherwise(y + n).alias("y1"))
    boxes = t.supplier.select((s * 7 % 200).alias("x0"), (s * 13 % 190).alias("y0"), (s * 7 % 200 + 9 + s % 7).alias("x1"), (s * 13 % 190 + 8).alias("y1"))
    return S.outside_lengths(segments, boxes, "k").select("k", F.round("length").cast("long").alias("length"), F.round("outside").cast("long").alias("outside"))


# --- votes for rows ----------------------------------------------------------------------------------------

_SEEN = "SELECT l_suppkey % 20 AS tile, l_partkey * 7 % 401 AS x, 25 * (l_orderkey % 16) + l_linenumber % 3 + (l_partkey * 7 % 401) * (l_suppkey % 5) // 8 AS y FROM lineitem"
_ANGLES = [5.0 * k for k in range(36)]
_GRID = ", ".join(f"({a}, {V._turn(a)[0]!r}, {V._turn(a)[1]!r})" for a in _ANGLES)
_VOTES = f"v AS (SELECT tile, angle, floor((y * c - x * s) / 4.0)::BIGINT AS bin, count(*) AS n FROM ({_SEEN}), (VALUES {_GRID}) g(angle, c, s) GROUP BY ALL)"
_BEST = """scored AS (SELECT tile, angle, (sum(n * n) * (max(bin) - min(bin) + 1) - sum(n) * sum(n))::DOUBLE / ((max(bin) - min(bin) + 1) * (max(bin) - min(bin) + 1)) AS score FROM v GROUP BY ALL),
best AS (SELECT tile, arg_max(angle::DOUBLE, struct_pack(s := score, a := -angle)) AS angle FROM scored GROUP BY tile)"""


def _seen(t: Tables) -> DataFrame:
    x = F.col("l_partkey") * 7 % 401
    return t.lineitem.select((F.col("l_suppkey") % 20).alias("tile"), x.alias("x"), (25 * (F.col("l_orderkey") % 16) + F.col("l_linenumber") % 3 + F.floor(x * (F.col("l_suppkey") % 5) / 8)).alias("y"))


@query("row_peaks", f"""WITH {_VOTES}, {_BEST}, top AS (SELECT v.tile, angle, bin, n, max(n) OVER (PARTITION BY v.tile ORDER BY bin RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, max(n) OVER (PARTITION BY v.tile ORDER BY bin RANGE BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS a
FROM v JOIN best USING (tile, angle)) SELECT tile, angle, row_number() OVER (PARTITION BY tile ORDER BY bin) AS peak, bin, n FROM top WHERE n >= 20 AND n > coalesce(b, 0) AND n >= coalesce(a, 0)""")
def row_peaks(t: Tables) -> DataFrame:
    """Votes for angle and offset per tile, the best angle, and peaks of its profile."""
    voted = V.votes(_seen(t), "tile", _ANGLES, 4.0)
    profile = voted.join(V.best_angles(voted, "tile").drop("score"), ["tile", "angle"])
    return V.peaks(profile, ["tile", "angle"], apart=4, least=20)


_ROUND = """l{k} AS (SELECT g, (sum(w * t * o) - sum(w * t) * sum(w * o) / sum(w)) / (sum(w * t * t) - sum(w * t) * sum(w * t) / sum(w)) AS a, sum(w) AS sw, sum(w * t) AS st, sum(w * o) AS so FROM w{k} GROUP BY g),
w{n} AS (SELECT p.g, t, o, CASE WHEN abs(o - a * t - (so - a * st) / sw) <= 2 THEN 1.0::DOUBLE ELSE 2.0 / abs(o - a * t - (so - a * st) / sw) END AS w FROM p JOIN l{k} USING (g))"""


@query(
    "band_fits",
    f"""WITH q AS (SELECT l_orderkey % 50 AS g, l_partkey::DOUBLE AS t, (l_partkey * (l_orderkey % 50) / 100.0 + l_linenumber + CASE WHEN l_suppkey % 11 = 0 THEN 60 ELSE 0 END)::DOUBLE AS o FROM lineitem),
c AS (SELECT g, avg(t) AS t0, avg(o) AS o0, count(*) AS n FROM q GROUP BY g), p AS (SELECT g, t - t0 AS t, o - o0 AS o FROM q JOIN c USING (g)), w0 AS (SELECT *, 1.0::DOUBLE AS w FROM p),
{", ".join(_ROUND.format(k=k, n=k + 1) for k in range(4))}
SELECT g, n, round(a, 6) AS slope, round((so - a * st) / sw + o0 - a * t0, 3) AS intercept FROM l3 JOIN c USING (g)""",
)
def band_fits(t: Tables) -> DataFrame:
    """Robust lines of all groups at once, four rounds of weighted sums."""
    g, x = F.col("l_orderkey") % 50, F.col("l_partkey")
    o = x * g / 100.0 + F.col("l_linenumber") + F.when(F.col("l_suppkey") % 11 == 0, 60).otherwise(0)
    lines = V.fit_lines(t.lineitem.select(g.alias("g"), x.cast("double").alias("t"), o.cast("double").alias("o")), ["g"], delta=2.0, rounds=4)
    return lines.select("g", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(
    "period_snr",
    """WITH p AS (SELECT l_suppkey % 10 AS g, l_partkey % 400 AS i, sum(1 + CASE WHEN l_partkey % (5 + l_suppkey % 10) = 0 THEN 4 ELSE 0 END)::DOUBLE AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT g, avg(v) AS mean FROM p GROUP BY g),
s AS (SELECT g, period, pow(sum((v - mean) * cos(2 * pi() * i / period)), 2) + pow(sum((v - mean) * sin(2 * pi() * i / period)), 2) AS power FROM p JOIN m USING (g), (SELECT 3 + k * 0.25::DOUBLE AS period FROM range(100) r(k)) GROUP BY ALL),
a AS (SELECT g, avg(power) FILTER (abs(1 / period - 1 / 8.0) <= 0.03 / 8.0) AS peak, avg(power) FILTER (abs(1 / period - 1 / 16.0) <= 0.03 / 16.0) AS sub, median(power) AS low FROM s GROUP BY g)
SELECT g, round(peak / low, 4) AS snr, sub > peak AS harmonic FROM a""",
)
def period_snr(t: Tables) -> DataFrame:
    """How far the power at a period of 8 stands above the median of all."""
    g, k = F.col("l_suppkey") % 10, F.col("l_partkey")
    v = 1 + F.when(k % (5 + g) == 0, 4).otherwise(0)
    profile = t.lineitem.groupBy(g.alias("g"), (k % 400).alias("i")).agg(F.sum(v).cast("double").alias("v"))
    power = V.periodogram(profile, ["g"], "i", "v", [3 + 0.25 * j for j in range(100)])
    return V.spectral_snr(power, ["g"], 8.0, wide=0.03).select("g", F.round("snr", 4).alias("snr"), "harmonic")


# --- chains, branches, grids -------------------------------------------------------------------------------


@query("chained_pieces")
def chained_pieces(t: Tables) -> DataFrame:
    """Pieces joined in order of cost unless they clash within a tile; tested against the one-by-one order."""
    k = F.col("c_custkey")
    pieces = t.customer.select(k.alias("piece"), (k % 7).alias("tile"), (k * 13 % 90).cast("double").alias("low"), (k * 13 % 90 + 4 + k % 9).cast("double").alias("high"))
    each = F.array(*(F.struct((k * s % m + 1).alias("b"), (k * 2 + j).alias("link")) for j, (s, m) in enumerate(((31, 149), (17, 113)))))
    links = t.customer.select(k.alias("a"), (k * 7 % 50).cast("double").alias("cost"), F.inline(each)).join(t.customer.select(k.alias("b")), "b", "left_semi")
    return U.chains(pieces, links.select("a", "b", "cost", "link"), overlap=1.0)


_BRANCHES = "SELECT o_orderkey AS branch, o_custkey % 400 AS u, 400 + o_orderkey % 700 AS v, 1 + o_orderkey % 9 AS length FROM orders"


@query(
    "spur_round",
    f"""WITH b AS ({_BRANCHES}), d AS (SELECT node, count(*) AS deg FROM (SELECT u AS node FROM b UNION ALL SELECT v FROM b) GROUP BY node),
x AS (SELECT b.*, du.deg AS du, dv.deg AS dv, length < 4 AND least(du.deg, dv.deg) = 1 AND greatest(du.deg, dv.deg) >= 3 AS spur FROM b JOIN d du ON du.node = u JOIN d dv ON dv.node = v)
SELECT count(*) AS n, sum(length)::BIGINT AS length FROM x WHERE NOT spur""",
)
def spur_round(t: Tables) -> DataFrame:
    """Branches left when spurs are pruned; no junction here loses all its branches and one round is enough, which the SQL takes for granted."""
    k = F.col("o_orderkey")
    branches = t.orders.select(k.alias("branch"), (F.col("o_custkey") % 400).alias("u"), (400 + k % 700).alias("v"), (1 + k % 9).cast("double").alias("length"))
    return K.prune_spurs(branches, 4.0).agg(F.count(F.lit(1)).alias("n"), F.sum("length").cast("long").alias("length"))


_TRIANGLES = "SELECT s_suppkey AS k, s_suppkey * 37 % 180 AS x, s_suppkey * 53 % 170 AS y, 5 + s_suppkey % 20 AS w, 4 + s_suppkey % 17 AS h FROM supplier"


@query(
    "coverage_grid",
    f"""WITH t AS ({_TRIANGLES}), e AS (SELECT k, x AS x0, y AS y0, x + w AS x1, y + 2 AS y1 FROM t UNION ALL SELECT k, x + w, y + 2, x + w // 2, y + h FROM t UNION ALL SELECT k, x + w // 2, y + h, x, y FROM t),
p AS (SELECT k, j, unnest(range(x, x + w + 1)) AS i FROM (SELECT k, x, w, unnest(range(y, y + h + 1)) AS j FROM t)), s AS (SELECT p.*, q, j + (q + 0.5) / 2 AS yc FROM p, range(2) r(q)),
c AS (SELECT s.k, j, i, q, abs(sum(CASE WHEN y1 > y0 THEN 1 ELSE -1 END * least(1, greatest(0, i + 1 - (x0 + (yc - y0) * (x1 - x0) / (y1 - y0)::DOUBLE))))) AS part FROM s JOIN e ON e.k = s.k AND least(y0, y1) <= yc AND yc < greatest(y0, y1) GROUP BY ALL),
g AS (SELECT j, i, least(1, round(sum(part) / 2, 6)) AS share FROM c WHERE i < 200 AND j < 200 GROUP BY ALL) SELECT j::BIGINT AS j, i::BIGINT AS i, share::DOUBLE AS share FROM g WHERE share > 0""",
)
def coverage_grid(t: Tables) -> DataFrame:
    """Shares of pixels that triangles cover; the SQL sums signed crossings per pixel."""
    k = F.col("s_suppkey")
    x, y, w, h = k * 37 % 180, k * 53 % 170, 5 + k % 20, 4 + k % 17
    corners = [(x, y), (x + w, y + 2), (x + F.floor(w / 2), y + h)]
    sides = F.array(*(F.struct(a[0].cast("double").alias("x0"), a[1].cast("double").alias("y0"), b[0].cast("double").alias("x1"), b[1].cast("double").alias("y1")) for a, b in zip(corners, corners[1:] + corners[:1])))
    grid = K.coverage(t.supplier.select(k.alias("k"), F.inline(sides)), key="k", width=200, height=200, samples=2)
    return grid.select("j", "i", F.round("share", 6).alias("share")).where("share > 0")


# --- blocks derived from objects ---------------------------------------------------------------------------

_PIECES = "SELECT s_suppkey % 13 AS g, s_suppkey * 23 % 90 AS x0, s_suppkey * 31 % 80 AS y0, 6 + s_suppkey % 9 AS w, 0 AS h FROM supplier"
_ALL = f"SELECT * FROM ({_SHEET}) UNION ALL SELECT * FROM ({_HOLE}) UNION ALL SELECT * FROM ({_PIECES})"


@query(
    "derived_blocks",
    f"""WITH big AS ({_paint(_ALL, 1)}), cells AS ({_erode('big', 1)}), o AS ({_SIZES.format(cells='cells')}),
corners AS (SELECT g, x + i AS vx, y + j AS vy, count(*) AS n, sum(i * 2 + j) AS s FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) GROUP BY ALL),
turns AS (SELECT g, CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND s = 3 THEN 2 ELSE 0 END) // 4 AS BIGINT) AS parts_less_holes FROM corners GROUP BY g),
a AS (SELECT g, CAST(count(*) AS DOUBLE) AS canopy_area FROM ({_paint(_SHEET)}) GROUP BY g), b AS (SELECT g, CAST(count(*) AS DOUBLE) AS interrow_area FROM ({_paint(_HOLE)}) GROUP BY g),
n AS (SELECT g, count(*) AS n_canopies FROM ({_SHEET}) GROUP BY g), p AS (SELECT g, count(*) AS n_row_pieces, CAST(sum(w) AS DOUBLE) AS row_length FROM ({_PIECES}) GROUP BY g)
SELECT g, coalesce(n_canopies, 0) AS n_canopies, coalesce(n_row_pieces, 0) AS n_row_pieces, coalesce(row_length, 0) AS row_length, coalesce(canopy_area, 0) AS canopy_area, coalesce(interrow_area, 0) AS interrow_area, o.area AS outline_area, o.length AS outline_length, parts_less_holes
FROM o JOIN turns USING (g) LEFT JOIN a USING (g) LEFT JOIN b USING (g) LEFT JOIN n USING (g) LEFT JOIN p USING (g)""",
)
def derived_blocks(t: Tables) -> DataFrame:
    """Blocks of overlapping crowns, lanes and row pieces: true areas, closed outlines."""
    k = F.col("s_suppkey")
    x, y = k * 23 % 90, k * 31 % 80
    pieces = t.supplier.select((k % 13).alias("g"), x.alias("x0"), y.alias("y0"), (x + 6 + k % 9).alias("x1"), y.alias("y1"))
    layers = [df.withColumn("tile", F.col("x0") % 3) for df in (_sheets(t), pieces, _holes(t))]
    out = derive(*layers, t.supplier.select((k % 13).alias("g"), k.cast("double").alias("position")), "g", "tile", reach=1.0, lone_reach=1.0)
    return out.select("g", "n_canopies", "n_row_pieces", "row_length", "canopy_area", "interrow_area", "outline_area", "outline_length", (F.col("n_parts") - F.col("n_holes")).alias("parts_less_holes"))
