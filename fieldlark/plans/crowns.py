"""Queries of crowns cut at necks, of objects cut by the edges of tiles and of annotation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators import labelling as L
from fieldlark.operators import necks as N
from fieldlark.operators import tile_edges as E
from fieldlark.sources import conversion as D

from .registry import Tables, query

# --- a line of crowns per twelve customers, joined by thinner bridges or none ------------------------------

_NECKS = N.Necks(along=24, ratio=0.75, piece=6, window=12, part=20)
_PLANTS = "SELECT c_custkey // 12 AS r, c_custkey % 12 AS i, 2 + c_custkey * 7 % 4 AS h, c_custkey * 5 % 4 AS b FROM customer"


def _crown_runs(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    r, i, h, b = F.floor(k / 12), k % 12, 2 + k * 7 % 4, k * 5 % 4
    crowns = t.customer.select((i * 10).alias("x0"), (i * 10 + 7).alias("x1"), F.explode(F.sequence(r * 20 + 10 - h, r * 20 + 10 + h)).alias("y"))
    bridges = t.customer.where(b > 0).select((i * 10 + 7).alias("x0"), (i * 10 + 10).alias("x1"), F.explode(F.sequence(r * 20 + 10, r * 20 + 10 + b - 1)).alias("y"))
    return crowns.unionByName(bridges).select("y", "x0", "x1")


@query(
    "neck_cuts",
    f"""WITH RECURSIVE plants AS ({_PLANTS}), named AS (SELECT *, r * 100 + coalesce(sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM plants),
px AS (SELECT p, x, unnest(range(r * 20 + 10 - h, r * 20 + 10 + h + 1)) AS y FROM (SELECT *, unnest(range(i * 10, i * 10 + 7)) AS x FROM named) UNION ALL SELECT p, x, unnest(range(r * 20 + 10, r * 20 + 10 + b)) FROM (SELECT *, unnest(range(i * 10 + 7, i * 10 + 10)) AS x FROM named)),
f AS (SELECT p, min(y) AS y0, min(x) AS x0, min(y * 1000 + x) AS first, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS extent, count(*) AS n FROM px GROUP BY p),
m AS (SELECT p, n::DOUBLE AS n, sum(x - x0)::DOUBLE AS sx, sum(y - y0)::DOUBLE AS sy, sum((x - x0) * (x - x0))::DOUBLE AS sxx, sum((y - y0) * (y - y0))::DOUBLE AS syy, sum((x - x0) * (y - y0))::DOUBLE AS sxy
  FROM px JOIN f USING (p) WHERE extent >= 24 / sqrt(2) AND n >= 40 GROUP BY p, n),
u AS (SELECT p, floor(cos(a) * 1048576 + 0.5)::BIGINT AS ux, floor(sin(a) * 1048576 + 0.5)::BIGINT AS uy FROM (SELECT p, 0.5 * atan2(2 * (sxy - sx * sy / n), (sxx - sx * sx / n) - (syy - sy * sy / n)) AS a FROM m)),
g AS (SELECT p, (x - x0) * ux + (y - y0) * uy AS t FROM px JOIN u USING (p) JOIN f USING (p)),
s AS (SELECT p, (t - low) // 2097152 AS i, count(*) AS n FROM g JOIN (SELECT p, min(t) AS low FROM g GROUP BY p) USING (p) GROUP BY ALL),
w AS (SELECT p, i, n, sum(n) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w, max(i) OVER (PARTITION BY p) AS last FROM s),
v AS (SELECT *, min(w) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS least, w::DOUBLE / least(max(w) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), max(w) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) AS depth FROM w),
c AS (SELECT p, i, depth, row_number() OVER (PARTITION BY p ORDER BY depth, i) AS k FROM v WHERE w = least AND depth <= 0.75 AND i >= 3 AND i <= last - 3 AND (last + 1) * 2 >= 24),
pick(p, k, taken) AS (SELECT DISTINCT p, 0::BIGINT, []::BIGINT[] FROM c UNION ALL SELECT pick.p, c.k, CASE WHEN len(list_filter(taken, lambda j: abs(j - c.i) < 3)) = 0 THEN list_append(taken, c.i) ELSE taken END FROM pick JOIN c ON c.p = pick.p AND c.k = pick.k + 1),
t AS (SELECT p, unnest(arg_max(taken, k)) AS i FROM pick GROUP BY p), part AS (SELECT s.p, (SELECT count(*) FROM t WHERE t.p = s.p AND t.i < s.i) AS q, sum(n) AS n FROM s ANTI JOIN t ON t.p = s.p AND t.i = s.i GROUP BY ALL)
SELECT first // 1000 AS first_y, first % 1000 AS first_x, i::BIGINT AS slice, depth, s.n AS n_cleared FROM t JOIN c USING (p, i) JOIN s USING (p, i) JOIN f USING (p) WHERE p NOT IN (SELECT p FROM part WHERE n < 20)""",
)
def neck_cuts(t: Tables) -> DataFrame:
    """Slices at which touching crowns are cut, with their pixels."""
    labelled = L.label_runs(_crown_runs(t))
    cuts, _ = N.necks(labelled, _NECKS)
    cleared = cuts.withColumnRenamed("n", "n_cleared")
    return cleared.join(L.places(labelled).select("place", "first_y", "first_x"), "place").drop("place")


# --- boxes cut by the edges of tiles -----------------------------------------------------------------------

_CUT = "SELECT s_suppkey AS k, s_suppkey % 5 AS r, s_suppkey // 5 % 20 AS c, (s_suppkey * 7 % 13 * 3)::DOUBLE AS x0, (s_suppkey * 11 % 13 * 3)::DOUBLE AS y0, (s_suppkey * 7 % 13 * 3 + 12)::DOUBLE AS x1, (s_suppkey * 11 % 13 * 3 + 8 + s_suppkey % 4)::DOUBLE AS y1 FROM supplier"


@query(
    "halves_of_objects",
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (ORDER BY r, c, y0, x0, x1, y1, k) AS o FROM ({_CUT})),
e AS (SELECT p.o AS i, q.o AS j, (least(p.y1, q.y1) - greatest(p.y0, q.y0)) / least(p.y1 - p.y0, q.y1 - q.y0) AS share FROM b p JOIN b q ON p.r = q.r AND p.c + 1 = q.c AND p.x1 >= 46 AND q.x0 <= 2
UNION ALL SELECT p.o, q.o, (least(p.x1, q.x1) - greatest(p.x0, q.x0)) / least(p.x1 - p.x0, q.x1 - q.x0) FROM b p JOIN b q ON p.c = q.c AND p.r + 1 = q.r AND p.y1 >= 46 AND q.y0 <= 2),
n AS (SELECT i, j, row_number() OVER (ORDER BY share DESC, i, j) AS k FROM e WHERE share >= 0.5),
t(k, used, i, j) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
SELECT n.k, CASE WHEN list_contains(used, n.i) OR list_contains(used, n.j) THEN used ELSE list_concat(used, [n.i, n.j]) END, CASE WHEN list_contains(used, n.i) OR list_contains(used, n.j) THEN NULL ELSE n.i END, n.j FROM t JOIN n ON n.k = t.k + 1),
p AS (SELECT i, j FROM t WHERE i IS NOT NULL), l AS (SELECT o, row_number() OVER (ORDER BY o) AS name FROM b WHERE o NOT IN (SELECT j FROM p)),
h AS (SELECT i AS o, i AS lead, 'a' AS half FROM p UNION ALL SELECT j, i, 'b' FROM p)
SELECT b.k, 'W' || CASE WHEN name < 10000 THEN lpad(name::VARCHAR, 4, '0') ELSE name::VARCHAR END || coalesce(half, '') AS object_name FROM b LEFT JOIN h ON h.o = b.o JOIN l ON l.o = coalesce(h.lead, b.o)""",
)
def halves_of_objects(t: Tables) -> DataFrame:
    """Boxes on both sides of a tile's edge paired one to one, all objects numbered."""
    k = F.col("s_suppkey")
    x, y = k * 7 % 13 * 3, k * 11 % 13 * 3
    corners = ((x, "x0"), (y, "y0"), (x + 12, "x1"), (y + 8 + k % 4, "y1"))
    boxes = t.supplier.select(k.alias("k"), (k % 5).alias("r"), (F.floor(k / 5) % 20).alias("c"), *(v.cast("double").alias(n) for v, n in corners))
    return E.object_names(boxes, "r", "c", "k", 48, "W", tol=2).select("k", "object_name")


# --- annotation documents ----------------------------------------------------------------------------------


@query(
    "document_layers",
    """WITH s AS (SELECT c_custkey AS k FROM customer), o AS (SELECT 'row_pieces' AS name, 2.5::DOUBLE AS m FROM s WHERE k % 4 = 0 AND k % 12 <> 0 AND k % 20 <> 0 UNION ALL SELECT 'canopies', (3 + k % 5) * 0.5::DOUBLE FROM s WHERE k % 4 = 1
UNION ALL SELECT 'waste', 1.5::DOUBLE FROM s WHERE k % 4 = 2 UNION ALL SELECT 'interrow_pieces', 1.0::DOUBLE FROM s WHERE k % 4 = 3 AND k % 7 <> 0
UNION ALL SELECT 'missing_attr', NULL FROM s WHERE k % 12 = 0 UNION ALL SELECT 'geom_dropped', NULL FROM s WHERE k % 4 = 0 AND k % 20 = 0 AND k % 12 <> 0 UNION ALL SELECT 'enum_normalized', NULL FROM s WHERE k % 8 = 0
UNION ALL SELECT 'geom_repaired', NULL FROM s WHERE k % 4 = 2 UNION ALL SELECT 'schema_violation', NULL FROM s WHERE k % 4 = 3 AND k % 7 = 0 UNION ALL SELECT 'bad_enum', NULL FROM s WHERE k % 4 = 3 AND k % 7 <> 0 AND k % 5 = 0)
SELECT name, count(*) AS n, sum(m) AS measure FROM o GROUP BY name""",
)
def document_layers(t: Tables) -> DataFrame:
    """Shapes of a document as layers with their lengths and areas, and its issues by code."""
    k = F.col("c_custkey")
    a, b = (k % 100).cast("double"), (k % 50).cast("double")
    kind = F.when(k % 4 == 0, "polyline").when((k % 4 == 2) | ((k % 4 == 3) & (k % 7 == 0)), "box").otherwise("polygon")
    label = F.element_at(F.array(*map(F.lit, ("row", "vineyard", "waste", "interrow_area"))), (k % 4 + 1).cast("int"))
    line = F.when(k % 20 == 0, F.array(a, b, a, b + 0.5)).otherwise(F.array(a, b, a + 3, b + 4))
    points = F.when(k % 4 == 0, line).when(k % 4 == 1, F.array(a, b, a + 3 + k % 5, b, a, b + 4)).when(k % 4 == 2, F.array(a + 2, b + 3, a, b)).otherwise(F.array(a, b, a + 2, b, a, b + 4))
    values = {"vineyard_id": F.lit("V01"), "row_id": F.when(k % 12 == 0, "").otherwise(F.concat(F.lit("V01-R"), k.cast("string"))), "row_structure": F.when(k % 8 == 0, "Regular").otherwise("regular"), "interrow_cover": F.when(k % 5 == 0, "odd").otherwise("bare")}
    tile = F.concat(F.lit("site_r00"), (k % 3).cast("string"), F.lit("_c00"), (F.floor(k / 3) % 4).cast("string"))
    shapes = t.customer.select(tile.alias("tile"), F.lit(2048).alias("width"), F.lit(2048).alias("height"), k.alias("seq"), kind.alias("kind"), label.alias("label"), points.alias("points"), F.create_map(*(x for n, v in values.items() for x in (F.lit(n), v))).alias("attributes"))
    tiles = shapes.select(F.col("tile").alias("tile_id")).distinct().select("tile_id", F.lit(1000.0).alias("x0"), F.lit(5000.0).alias("y0"), F.lit(0.5).alias("gsd_m"))
    objects, issues = D.document_objects(shapes, tiles)
    out = issues.groupBy(F.col("code").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("measure"))
    for name, df in D.to_layers(objects, source="manual", run_id="r").items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n"), F.sum("length_m" if name == "row_pieces" else "area_m2").alias("measure")).select(F.lit(name).alias("name"), "n", "measure"))
    return out
