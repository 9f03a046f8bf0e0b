"""Queries of functions and reports that the other query modules don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.functions import numbers as N
from fieldlark.functions import text as X
from fieldlark.operators import evaluate as E
from fieldlark.operators import graph as G
from fieldlark.operators import matching as M
from fieldlark.operators import reports as R
from fieldlark.operators import stats as S
from fieldlark.operators import survey as V

from .registry import Tables, query
from .relational import cents

_ROUND = "floor(({}) * 1000000 + 0.5) / 1000000"

# --- boxes of the star tables ------------------------------------------------------------------------------

_MADE = "SELECT p_partkey AS k, p_partkey % 13 AS tile, CAST((p_partkey * 7) % 400 AS DOUBLE) AS x0, CAST(p_partkey // 13 % 300 AS DOUBLE) AS y0, CAST((p_partkey * 7) % 400 + 3 + p_size % 4 AS DOUBLE) AS x1, CAST(p_partkey // 13 % 300 + 4 AS DOUBLE) AS y1 FROM part"
_TRUE = "SELECT s_suppkey AS k, s_suppkey % 13 AS tile, CAST((s_suppkey * 7 + s_suppkey % 2) % 400 AS DOUBLE) AS x0, CAST(s_suppkey // 13 % 300 AS DOUBLE) AS y0, CAST((s_suppkey * 7 + s_suppkey % 2) % 400 + 5 AS DOUBLE) AS x1, CAST(s_suppkey // 13 % 300 + 4 AS DOUBLE) AS y1 FROM supplier"
_INTER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def _made(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k * 7) % 400, F.floor(k / 13) % 300
    return t.part.select(k.alias("k"), (k % 13).alias("tile"), *(c.cast("double").alias(n) for c, n in ((x, "x0"), (y, "y0"), (x + 3 + F.col("p_size") % 4, "x1"), (y + 4, "y1"))))


def _true(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 7 + k % 2) % 400, F.floor(k / 13) % 300
    return t.supplier.select(k.alias("k"), (k % 13).alias("tile"), *(c.cast("double").alias(n) for c, n in ((x, "x0"), (y, "y0"), (x + 5, "x1"), (y + 4, "y1"))))


@query(
    "box_scores",
    f"""WITH p AS ({_MADE}), r AS ({_TRUE}),
j AS (SELECT a.tile, a.k AS p, b.k AS q, {_INTER} AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS both_ FROM p a JOIN r b ON a.tile = b.tile AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
k AS (SELECT *, i / (both_ - i) AS iou FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY tile, p ORDER BY iou DESC, q) AS op, row_number() OVER (PARTITION BY tile, q ORDER BY iou DESC, p) AS oq FROM k),
m AS (SELECT tile, sum(i) AS common, count(*) FILTER (op = 1 AND oq = 1 AND iou >= 0.5) AS tp FROM o GROUP BY 1),
x AS (SELECT tile, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS a FROM p GROUP BY 1), y AS (SELECT tile, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS a FROM r GROUP BY 1),
f AS (SELECT coalesce(x.tile, y.tile) AS tile, coalesce(x.n, 0) AS n_pred, coalesce(y.n, 0) AS n_ref, coalesce(m.tp, 0) AS tp, coalesce(m.common, 0) AS c, coalesce(x.a, 0) + coalesce(y.a, 0) - coalesce(m.common, 0) AS u FROM x FULL JOIN y ON x.tile = y.tile LEFT JOIN m ON m.tile = coalesce(x.tile, y.tile)),
g AS (SELECT *, CASE WHEN u > 0 THEN c / u ELSE 1.0 END AS iou, CASE WHEN n_pred + n_ref = 0 THEN 1.0 ELSE 2.0::DOUBLE * tp / (n_pred + n_ref) END AS f1 FROM f)
SELECT tile, n_pred, n_ref, tp, {_ROUND.format('iou')} AS iou, {_ROUND.format('f1')} AS f1, {_ROUND.format('0.6::DOUBLE * iou + 0.4::DOUBLE * f1')} AS score FROM g""",
)
def box_scores(t: Tables) -> DataFrame:
    return R.box_scores(_made(t), _true(t), "tile", "k", cell=16, least=0.5, w_area=0.6, w_match=0.4)


@query(
    "overlap_issues",
    f"WITH a AS ({_MADE}), b AS ({_TRUE}) SELECT a.tile, a.k, sum({_INTER}) AS overlap FROM a JOIN b ON a.tile = b.tile AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY 1, 2 HAVING sum({_INTER}) > 8",
)
def overlap_issues(t: Tables) -> DataFrame:
    return R.overlap_issues(_made(t), _true(t), "tile", "k", cell=16, limit=8)


@query(
    "false_area_penalty",
    f"WITH p AS ({_MADE}), e AS (SELECT DISTINCT tile FROM ({_TRUE}) WHERE tile % 3 <> 1), c AS (SELECT tile, sum((x1 - x0) * (y1 - y0)) AS a FROM p GROUP BY 1) SELECT e.tile, least(1.0::DOUBLE, {_ROUND.format('2.0::DOUBLE * coalesce(a, 0) / 120000')}) AS penalty FROM e LEFT JOIN c USING (tile)",
)
def false_area_penalty(t: Tables) -> DataFrame:
    return R.false_area_penalty(_made(t), _true(t).where("tile % 3 <> 1").select("tile").distinct(), "tile", tile_area=120_000.0, factor=2.0)


_GATE = "SELECT n_nationkey AS passage, CAST(n_nationkey * 16 AS DOUBLE) AS x0, 0.0::DOUBLE AS y0, CAST(n_nationkey * 16 + 4 AS DOUBLE) AS x1, 400.0::DOUBLE AS y1 FROM nation WHERE n_nationkey % 2 = 0"


@query(
    "close_blocks",
    f"""WITH b AS ({_TRUE}), g AS ({_GATE}),
n AS (SELECT a.k AS a, b.k AS b FROM b a JOIN b b ON a.k < b.k AND pow(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)), 2) + pow(greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)), 2) < 9),
m AS (SELECT b.k, g.passage AS p FROM b JOIN g ON b.x0 - 3 <= g.x1 AND g.x0 <= b.x1 + 3 AND b.y0 - 3 <= g.y1 AND g.y0 <= b.y1 + 3)
SELECT a, b FROM n WHERE NOT EXISTS (SELECT 1 FROM m x JOIN m y ON x.p = y.p WHERE x.k = n.a AND y.k = n.b)""",
)
def close_blocks(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    gates = t.nation.where(k % 2 == 0).select(k.alias("passage"), (k * 16).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (k * 16 + 4).cast("double").alias("x1"), F.lit(400.0).alias("y1"))
    return R.close_blocks(_true(t), "k", cell=16, gap=3, passages=gates)


_PIECE = "SELECT s_suppkey AS k, s_suppkey % 3 AS r, s_suppkey // 3 % 40 AS c, CAST((s_suppkey * 7) % 40 AS DOUBLE) AS x0, CAST((s_suppkey * 11) % 40 AS DOUBLE) AS y0, CAST((s_suppkey * 7) % 40 + 9 AS DOUBLE) AS x1, CAST((s_suppkey * 11) % 40 + 9 AS DOUBLE) AS y1 FROM supplier"


@query(
    "objects_across_tiles",
    f"""WITH RECURSIVE b AS ({_PIECE}),
l AS (SELECT p.k AS a, q.k AS b FROM b p JOIN b q ON p.r = q.r AND p.c + 1 = q.c AND p.x1 >= 47 AND q.x0 <= 1 AND p.y0 < q.y1 AND q.y0 < p.y1
UNION SELECT p.k, q.k FROM b p JOIN b q ON p.c = q.c AND p.r + 1 = q.r AND p.y1 >= 47 AND q.y0 <= 1 AND p.x0 < q.x1 AND q.x0 < p.x1),
s AS (SELECT a, b FROM l UNION SELECT b, a FROM l), w(node, reach) AS (SELECT k, k FROM b UNION SELECT w.node, s.b FROM w JOIN s ON s.a = w.reach), o AS (SELECT node AS k, min(reach) AS object_id FROM w GROUP BY 1),
n AS (SELECT object_id, row_number() OVER (ORDER BY object_id) AS i FROM (SELECT DISTINCT object_id FROM o))
SELECT k, object_id, 'W' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END AS name FROM o JOIN n USING (object_id)""",
)
def objects_across_tiles(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 7) % 40, (k * 11) % 40
    boxes = t.supplier.select(k.alias("k"), (k % 3).alias("r"), (F.floor(k / 3) % 40).alias("c"), *(v.cast("double").alias(n) for v, n in ((x, "x0"), (y, "y0"), (x + 9, "x1"), (y + 9, "y1"))))
    return R.numbered_objects(R.pieces_across_tiles(boxes, "r", "c", "k", 48, tol=1), "W")


@query(
    "zonal_share",
    f"""WITH z AS (SELECT n_nationkey AS zone, n_regionkey AS tile, CAST(n_nationkey AS DOUBLE) AS x0, 1.0::DOUBLE AS y0, CAST(n_nationkey + 20 AS DOUBLE) AS x1, CAST(2 + n_nationkey % 5 AS DOUBLE) AS y1 FROM nation)
SELECT z.tile, z.zone, count(*) AS pixels, {_ROUND.format("avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END)")} AS share FROM z JOIN lineitem ON l_suppkey % 5 = z.tile AND l_quantity >= x0 AND l_quantity < x1 AND l_linenumber >= y0 AND l_linenumber < y1 GROUP BY 1, 2""",
)
def zonal_share(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    zones = t.nation.select(k.alias("zone"), F.col("n_regionkey").cast("long").alias("tile"), k.cast("double").alias("x0"), F.lit(1.0).alias("y0"), (k + 20).cast("double").alias("x1"), (2 + k % 5).cast("double").alias("y1"))
    pixels = t.lineitem.select((F.col("l_suppkey") % 5).alias("tile"), "l_quantity", F.col("l_linenumber").cast("double").alias("line"), (F.col("l_returnflag") == "R").alias("hit"))
    return R.zonal_share(pixels, zones, "tile", "zone", ("l_quantity", "line"), "hit", cell=8)


# --- tiles, routes, targets --------------------------------------------------------------------------------


@query("tile_stats", "SELECT o_custkey % 16 AS r, o_orderkey % 9 AS c, count(*) AS tiles, floor(avg(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) * 10000 + 0.5) / 10000 AS price, floor(avg(CASE WHEN o_orderstatus = 'F' THEN o_custkey END) * 10000 + 0.5) / 10000 AS done FROM orders GROUP BY 1, 2")
def tile_stats(t: Tables) -> DataFrame:
    o = t.orders.select((F.col("o_custkey") % 16).alias("r"), (F.col("o_orderkey") % 9).alias("c"), cents("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("done"))
    return R.tile_stats(o, "r", "c", ["price", "done"])


@query("tiles_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) AS n_other FROM orders")
def tiles_summary(t: Tables) -> DataFrame:
    return R.tiles_summary(t.orders, "o_orderstatus", ["F", "O"])


_WALK = "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 END AS driven, CASE WHEN c_custkey % 5 < 3 THEN c_custkey % 77 END AS planned, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 END AS n FROM customer"


@query("route_summary", f"SELECT k, coalesce(driven, planned, 0) AS length, CASE WHEN driven IS NOT NULL THEN 'driven' WHEN planned IS NOT NULL THEN 'planned' ELSE 'none' END AS source, coalesce(n, 0) AS targets FROM ({_WALK})")
def route_summary(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return R.route_summary(t.customer.select(k.alias("k"), F.when(k % 3 == 0, k % 100).alias("driven"), F.when(k % 5 < 3, k % 77).alias("planned"), F.when(k % 2 == 0, k % 9).alias("n")), "k", "planned", "driven", "n")


@query("ordered_targets", "SELECT c_nationkey, 'T' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 50 END AS pos, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 50 END NULLS LAST, c_custkey) AS seq FROM customer")
def ordered_targets(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return R.ordered_targets(t.customer.select("c_nationkey", F.concat(F.lit("T"), k).alias("name"), F.when(k % 4 == 0, k % 50).alias("pos")), "c_nationkey", "pos", "name")


@query("hard_reject", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'short' WHEN p_retailprice < 950 THEN 'cheap' WHEN p_type = 'STANDARD' THEN 'kind' END AS reason FROM part")
def hard_reject(t: Tables) -> DataFrame:
    gates = [("short", F.col("p_size") < 5), ("cheap", F.col("p_retailprice") < 950), ("kind", F.col("p_type") == "STANDARD")]
    return t.part.select("p_partkey", R.hard_reject(gates).alias("reason"))


@query("decimals_of_steps", "SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS decimals FROM nation")
def decimals_of_steps(t: Tables) -> DataFrame:
    step = F.element_at(F.lit([1.0, 0.1, 0.01, 0.001, 0.5, 0.0]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return t.nation.select("n_nationkey", R.decimals_for(step).alias("decimals"))


@query(
    "axial_median",
    """WITH s AS (SELECT s_nationkey, CAST((s_suppkey * 7) % 60 + 60 AS DOUBLE) AS a FROM supplier),
m AS (SELECT s_nationkey, degrees(atan2(sum(sin(radians(a * 2))), sum(cos(radians(a * 2))))) / 2 AS mean FROM s GROUP BY 1),
n AS (SELECT s_nationkey, CASE WHEN mean < 0 THEN mean + 180 ELSE mean END AS mean FROM m)
SELECT s_nationkey, floor((n.mean + quantile_disc(s.a - n.mean, 0.5)) * 1000000 + 0.5) / 1000000 AS median_deg FROM s JOIN n USING (s_nationkey) GROUP BY s_nationkey, n.mean""",
)
def axial_median(t: Tables) -> DataFrame:
    s = t.supplier.select("s_nationkey", ((F.col("s_suppkey") * 7) % 60 + 60).cast("double").alias("a"))
    return R.axial_median(s, ["s_nationkey"], "a").select("s_nationkey", N.round_up(F.col("median_deg"), 6).alias("median_deg"))


@query("unknown_blocks", "SELECT p_partkey, p_brand FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_brand END AS p_brand FROM part) WHERE trim(p_brand) <> '' AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_brand < 'Brand#3')")
def unknown_blocks(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.col("p_brand")).alias("p_brand"))
    return R.unknown_blocks(named, t.part.where("p_brand < 'Brand#3'"), "p_partkey", "p_brand")


@query(
    "upload_issues",
    """WITH e AS (SELECT 'f' || p_partkey AS name, md5(p_name) AS d FROM part WHERE p_partkey % 7 <> 0), f AS (SELECT 'f' || p_partkey AS name, CASE WHEN p_partkey % 11 = 0 THEN md5(p_brand) ELSE md5(p_name) END AS d FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'f' || p_partkey, md5(p_name) FROM part WHERE p_partkey % 13 = 0),
g AS (SELECT name, count(*) AS n, min(d) AS low, max(d) AS high FROM f GROUP BY 1), j AS (SELECT coalesce(e.name, g.name) AS name, CASE WHEN e.name IS NULL THEN 'not_expected' WHEN g.name IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN low <> d OR high <> d THEN 'other_digest' END AS issue FROM e FULL JOIN g ON e.name = g.name)
SELECT * FROM j WHERE issue IS NOT NULL""",
)
def upload_issues(t: Tables) -> DataFrame:
    k, d = F.col("p_partkey"), F.md5(F.col("p_name").cast("binary"))
    name = F.concat(F.lit("f"), k).alias("name")
    found = t.part.where(k % 5 != 0).select(name, F.when(k % 11 == 0, F.md5(F.col("p_brand").cast("binary"))).otherwise(d).alias("d")).union(t.part.where(k % 13 == 0).select(name, d))
    return R.upload_issues(t.part.where(k % 7 != 0).select(name, d.alias("d")), found, "name", "d")


_ROWS = "SELECT s_nationkey AS b, s_suppkey AS k, CAST((s_suppkey * 13) % 1000 AS BIGINT) AS p, s_suppkey % 40 AS lo, s_suppkey % 40 + 50 + s_suppkey % 7 AS hi FROM supplier"


def _rows(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(F.col("s_nationkey").alias("b"), k.alias("k"), ((k * 13) % 1000).alias("p"), (k % 40).alias("lo"), (k % 40 + 50 + k % 7).alias("hi"))


@query("lanes", f'WITH r AS ({_ROWS}), w AS (SELECT b, k AS "left", lead(k) OVER v AS "right", (p + lead(p) OVER v) / 2.0::DOUBLE AS middle, lead(p) OVER v - p AS width FROM r WINDOW v AS (PARTITION BY b ORDER BY p, k)) SELECT * FROM w WHERE "right" IS NOT NULL')
def lanes(t: Tables) -> DataFrame:
    return R.lanes(_rows(t), "b", "k", "p")


@query(
    "sweep_length",
    f"""WITH r AS ({_ROWS}), q AS (SELECT b, p, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p) % 2 = 1 AS odd FROM q), e AS (SELECT b, p, CASE WHEN odd THEN lo ELSE hi END AS s, CASE WHEN odd THEN hi ELSE lo END AS f FROM w),
d AS (SELECT b, abs(f - s) + coalesce(abs(s - lag(f) OVER v) + abs(p - lag(p) OVER v), 0) AS way FROM e WINDOW v AS (PARTITION BY b ORDER BY p)) SELECT b, count(*) AS lanes, CAST(sum(way) AS BIGINT) AS length FROM d GROUP BY 1""",
)
def sweep_length(t: Tables) -> DataFrame:
    return R.sweep_length(_rows(t).groupBy("b", "p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "b", "p", "lo", "hi")


# --- functions ---------------------------------------------------------------------------------------------


@query(
    "ring_measures",
    """WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 17 + 1 AS DOUBLE) AS b FROM part)
SELECT k, a * b AS area, a * b - 1 AS with_hole, 2 * a + b AS length, 4 AS n_points, CASE WHEN 3 < a AND 2 < b THEN true ELSE false END AS inside FROM p""",
)
def ring_measures(t: Tables) -> DataFrame:
    a, b = F.col("p_size").cast("double"), (F.col("p_partkey") % 17 + 1).cast("double")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    ring = F.array(pt(zero, zero), pt(a, zero), pt(a, b), pt(zero, b))
    hole = F.array(*(pt(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0))))
    noisy = F.array(pt(zero, zero), pt(zero, zero), pt(a, zero), pt(a, b), pt(a, b), pt(zero, b))
    shape = N.drop_repeated_points(N.round_points(noisy, 3))
    inside = N.point_in_ring(F.lit(3.0), F.lit(2.0), ring)
    return t.part.select(F.col("p_partkey").alias("k"), N.ring_area(ring).alias("area"), N.polygon_area(F.array(ring, hole)).alias("with_hole"), N.line_length(shape).alias("length"), F.size(shape).alias("n_points"), inside.alias("inside"))


@query(
    "grid_functions",
    """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 1000 AS DOUBLE) AS x, CAST(p_size * 20 AS DOUBLE) AS y FROM part)
SELECT k, CAST(floor((5000 - y) / 51.2::DOUBLE + 1e-9) AS INTEGER) AS r, CAST(floor(x / 51.2::DOUBLE + 1e-9) AS INTEGER) AS c, 100 + x * 0.25::DOUBLE AS mx, 900 - y * 0.25::DOUBLE AS my, (x - 100) / 0.25::DOUBLE AS pu, (900 - y) / 0.25::DOUBLE AS pv,
CAST((ceil((x + 60) / 51.2::DOUBLE - 1e-9) - floor(x / 51.2::DOUBLE + 1e-9)) * (ceil((5000 - y) / 51.2::DOUBLE - 1e-9) - floor((5000 - y - 40) / 51.2::DOUBLE + 1e-9)) AS INTEGER) AS n_tiles,
CAST(floor((y + 10000.0) * 10.0 + 0.5) AS BIGINT) >> 16 AS red, (CAST(floor((y + 10000.0) * 10.0 + 0.5) AS BIGINT) >> 8) % 256 AS green, CAST(floor((y + 10000.0) * 10.0 + 0.5) AS BIGINT) % 256 AS blue,
CASE WHEN x < 400 AND x + 30 > 200 THEN least(x + 30, 400) - greatest(x, 200) END AS clip_width FROM p""",
)
def grid_functions(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 1000).cast("double").alias("x"), (F.col("p_size") * 20).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    n = lambda v: F.lit(float(v))
    at, m, px, rgb = N.tile_of_point(x, y, 0.0, 5000.0), N.pixel_to_metres(x, y, n(100), n(900), n(0.25)), N.metres_to_pixel(x, y, n(100), n(900), n(0.25)), N.encode_height(y)
    clip = N.clip_box([x, y, x + 30, y + 40], [n(200), n(-1), n(400), n(5000)])
    return p.select(
        "k", at["row"].alias("r"), at["col"].alias("c"), m["x"].alias("mx"), m["y"].alias("my"), px["u"].alias("pu"), px["v"].alias("pv"), F.size(N.tiles_of_box(x, y, x + 60, y + 40, 0.0, 5000.0)).alias("n_tiles"),
        rgb[0].alias("red"), rgb[1].alias("green"), rgb[2].alias("blue"), (clip["x1"] - clip["x0"]).alias("clip_width"),
    )


@query(
    "text_forms",
    """WITH p AS (SELECT p_partkey AS k, p_name, p_size, p_brand FROM part)
SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) + 0.5 END AS area_ha, CAST(p_size + 3 AS INTEGER) AS mask_size, CAST(p_size AS INTEGER) AS mask_set, 'a;b;' || p_brand AS flags, 'șes ' || lower(p_name) AS landuse, 'part' || k AS batch,
DATE '2024-03-01' + INTERVAL (k % 20) DAY + INTERVAL 10 HOUR AS made_at, CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS safe, CASE WHEN k % 2 = 0 THEN 'Waste near ' || p_brand ELSE 'Missing Plant in ' || p_brand END AS title FROM p""",
)
def text_forms(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    day = F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), (k % 20).cast("int")), "yyyyMMdd")
    mask = X.rle_to_mask(X.parse_rle(F.concat(F.lit("3, "), size)))
    return t.part.select(
        k.alias("k"), X.parse_area_ha(F.when(k % 3 == 0, F.concat(size, F.lit(" sqm"))).otherwise(F.concat(F.lit(" "), size, F.lit(",5 ha")))).alias("area_ha"), F.size(mask).alias("mask_size"), F.size(F.filter(mask, lambda m: m)).alias("mask_set"),
        X.merge_flags(F.lit("a; b"), F.lit(None).cast("string"), F.concat(F.lit("b;"), F.col("p_brand"), F.lit(";a"))).alias("flags"), X.normalize_landuse(F.concat(F.lit("  Şes \t"), F.col("p_name"))).alias("landuse"),
        X.batch_of(F.concat(F.lit("part"), k, F.lit("_r001_c002.png"))).alias("batch"), X.generated_at(F.concat(day, F.lit("T1000-run-abc"))).alias("made_at"),
        X.json_safe(F.when(k % 4 == 0, float("nan")).otherwise(k.cast("double"))).alias("safe"), X.task_title(F.when(k % 2 == 0, "waste").otherwise("missing_plant"), F.lit(None).cast("string"), F.col("p_brand"), F.lit(1.0)).alias("title"),
    )


@query(
    "score_rules",
    f"""WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) / 50 AS s, CAST(p_partkey % 7 AS DOUBLE) / 7 AS b, p_size AS z FROM part)
SELECT k, s + 0.5::DOUBLE * b * (1 - s) AS score, CASE WHEN s >= 0.8 AND b >= 0.2 THEN 'accept' WHEN s >= 0.4 THEN 'review' ELSE 'reject' END AS decision, {_ROUND.format('b * least(1.0, greatest(0.0, (ln(greatest(z, 4)) - ln(4)) / (ln(40) - ln(4))))')} AS saliency,
CASE WHEN z < 5 THEN 'fit' WHEN k % 3 = 0 THEN 'hard' WHEN k % 5 = 0 THEN 'soft' END AS reason, abs((z - 1.5::DOUBLE) / 4 - round_even((z - 1.5::DOUBLE) / 4, 0)) * 4 AS phase_m FROM p""",
)
def score_rules(t: Tables) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    s, b = z.cast("double") / 50, (k % 7).cast("double") / 7
    reason = N.first_reason(F.when(z < 5, "fit"), F.when(k % 3 == 0, "hard"), F.when(k % 5 == 0, "soft"))
    return t.part.select(
        k.alias("k"), N.rank_score(s, b, 0.5).alias("score"), N.decide(s, b, accept=0.8, review=0.4, least_margin=0.2).alias("decision"), N.round_up(N.saliency(b, z.cast("double"), 4.0, 40.0), 6).alias("saliency"),
        reason.alias("reason"), N.phase_distance(z.cast("double"), F.lit(4.0), F.lit(1.5)).alias("phase_m"),
    )


# --- merges and orders -------------------------------------------------------------------------------------


@query(
    "merged_statistics",
    "WITH p AS (SELECT l_suppkey AS k, l_returnflag AS f, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS m FROM lineitem GROUP BY 1, 2) SELECT k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS m, list_sort(list_distinct(list(f))) AS flags FROM p GROUP BY 1",
)
def merged_statistics(t: Tables) -> DataFrame:
    parts = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("m"))
    return E.merge_stats(parts.select("k", "n", "m", F.array("f").alias("flags")), "k", ["n", "m"], ["flags"])


@query(
    "component_report",
    """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 1 + s_suppkey % 5 AS b, 1 + s_suppkey % 9 AS w FROM supplier WHERE s_suppkey % 3 = 0), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach), c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)
SELECT c.component, count(*) AS n_nodes, any_value(x.n) AS n_edges, CAST(any_value(x.l) AS BIGINT) AS length, max(CASE WHEN node = 3 THEN 1 ELSE 0 END) AS has_start FROM c JOIN (SELECT c.component, count(*) AS n, sum(w) AS l FROM e JOIN c ON e.a = c.node GROUP BY 1) x ON x.component = c.component GROUP BY 1""",
)
def component_report(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    e = t.supplier.where(k % 3 == 0).select(k.alias("a"), (k + 1 + k % 5).alias("b"), (1 + k % 9).alias("w"))
    return G.component_report(G.components(e.select("a", "b")), e, "w", start=3)


@query("structure_any", "SELECT s_nationkey AS k, CASE WHEN bool_or(s_suppkey % 9 = 0) THEN 'disrupted' WHEN bool_or(s_suppkey % 9 <= 4) THEN 'regular' ELSE 'unassessable' END AS structure FROM supplier GROUP BY 1")
def structure_any(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 9
    kind = F.when(k == 0, "disrupted").when(k <= 4, "regular").otherwise("unassessable")
    return t.supplier.select(F.col("s_nationkey").alias("k"), kind.alias("v")).groupBy("k").agg(S.structure_any(F.col("v")).alias("structure"))


@query("order_blocks", "SELECT n_nationkey AS k, CAST((n_nationkey * 7) % 10 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y, row_number() OVER (ORDER BY n_nationkey // 5 DESC, (n_nationkey * 7) % 10, n_nationkey) AS block_no FROM nation")
def order_blocks(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return V.order_blocks(t.nation.select(k.alias("k"), ((k * 7) % 10).cast("double").alias("x"), F.floor(k / 5).cast("double").alias("y")), "x", "y", "k")


@query(
    "merge_decisions",
    f"""WITH c AS (SELECT * FROM ({_MADE}) WHERE k % 4 = 0), d AS (SELECT k AS line, tile, x0 + k % 3 AS x0, y0, x1 + k % 3 AS x1, y1, CASE k % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'accept' ELSE 'add' END AS decision FROM ({_MADE}) WHERE k % 3 = 0),
h AS (SELECT a.k, b.line, b.decision FROM c a JOIN d b ON a.tile = b.tile AND {_INTER} > 0 WHERE {_INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER}) >= 0.5),
l AS (SELECT k, arg_max(decision, line) AS last FROM h GROUP BY 1)
SELECT tile, CAST(c.k AS VARCHAR) AS k, x0, y0, x1, y1, CASE WHEN last IS NULL THEN 'auto' ELSE 'confirmed' END AS origin FROM c LEFT JOIN l ON c.k = l.k WHERE coalesce(last, '') <> 'reject'
UNION ALL SELECT tile, 'manual-' || line, x0, y0, x1, y1, 'manual' FROM d WHERE decision IN ('accept', 'add') AND line NOT IN (SELECT line FROM h)""",
)
def merge_decisions(t: Tables) -> DataFrame:
    k = F.col("k")
    kind = F.when(k % 5 == 0, "reject").when(k % 5 == 1, "accept").otherwise("add")
    d = _made(t).where(k % 3 == 0).select(k.alias("line"), "tile", (F.col("x0") + k % 3).alias("x0"), "y0", (F.col("x1") + k % 3).alias("x1"), "y1", kind.alias("decision"))
    return M.merge_decisions(_made(t).where(k % 4 == 0), d, "tile", "k", "line", "decision", least=0.5)


@query("interrow_ids", f"WITH r AS ({_ROWS}), w AS (SELECT b, row_number() OVER v AS i, lead(k) OVER v AS nxt FROM r WINDOW v AS (PARTITION BY b ORDER BY p, k)) SELECT CAST(b AS VARCHAR) AS block, i, i + 1 AS j, i AS k, b || '-I' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS interrow_id FROM w WHERE nxt IS NOT NULL")
def interrow_ids(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("b").orderBy("p", "k")
    pairs = _rows(t).select("b", F.row_number().over(w).alias("i"), F.lead("k").over(w).alias("nxt")).where("nxt is not null").select(F.col("b").cast("string").alias("block"), "i", (F.col("i") + 1).alias("j"))
    return V.interrow_ids(pairs, "block", "i", "j")
