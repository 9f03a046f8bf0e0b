"""Queries of shape checks and block tables, on shapes and blocks made of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators import blocks as B
from fieldlark.operators import shapes as H

from .library import _GATE, _TRUE, _true
from .registry import Tables, query

LABELS = {
    "area": H.Label("polygon", ("block", "cover"), {"cover": ("bare", "grass")}),
    "line": H.Label("polyline", ("block",), {}),
    "spot": H.Label("box", ("block",), {}),
}
_POINTS = (
    (10, 10, 10, 20, 20, 20, 20, 10),
    (20, 10, 20, 20, 10, 20, 10, 10),  # the other way round
    (10, 10, 10, 20, 20, 20, 20, 10, 10, 10),  # closed
    (10, 10, 10, 20, 10, 20, 20, 20, 20, 10),  # a corner twice
    (10, 10, 10, 20, 10, 10),  # two corners
    (10, 10, 20, 20, 10, 20, 20, 10),  # bow tie
    (10, 10, 10, 10.5, 10.5, 10.5, 10.5, 10),  # small
    (10, 10, 10, 120, 20, 120, 20, 10),  # outside
    (10, 10, 10.5, 10),  # short line
    (20, 10, 10, 20),  # box the wrong way
    (10, 10, 10, 20),
    (10, 10, 10, 20),
)
_NAMES = (
    (("block", "V1"), ("cover", "bare")),
    (("block", ""), ("cover", "bare")),
    (("block", " V1"), ("cover", "bare")),
    (("cover", "bare"),),
    (("block", "V1"), ("cover", "grass"), ("note", "")),
    (("block", "V1"), ("block", "V1"), ("cover", "grass")),
    (("cover", "grass"), ("block", "V1")),
    (("block", "V1"), ("cover", "Grass")),
)


@query(
    "shape_issues",
    """WITH s AS (SELECT p_partkey AS seq, p_partkey % 40 AS image, p_partkey % 12 AS c, p_partkey // 12 % 8 AS a, p_partkey % 5 AS f FROM part), known AS (SELECT *, c <= 7 AS area FROM s WHERE c < 10),
i(severity, code, detail, seq, image) AS (
SELECT 'error', 'unknown_label', 'blob', seq, image FROM s WHERE c = 10 UNION ALL SELECT 'error', 'wrong_shape', 'polyline', seq, image FROM s WHERE c = 11
UNION ALL SELECT 'warning', 'shape_source', 'auto', seq, image FROM known WHERE f = 0
UNION ALL SELECT CASE WHEN c = 3 THEN 'warning' ELSE 'error' END, CASE c WHEN 1 THEN 'wrong_orientation' WHEN 2 THEN 'closing_vertex' WHEN 3 THEN 'duplicate_vertex' WHEN 4 THEN 'too_few_vertices' WHEN 5 THEN 'invalid_geometry' WHEN 6 THEN 'area_too_small' WHEN 7 THEN 'coord_out_of_range' WHEN 8 THEN 'polyline_too_short' ELSE 'box_degenerate' END, CASE WHEN c = 4 THEN '2' ELSE '' END, seq, image FROM known WHERE c > 0
UNION ALL SELECT 'error', 'closing_vertex', '', seq, image FROM known WHERE c = 4
UNION ALL SELECT 'error', CASE a WHEN 1 THEN 'empty_id' WHEN 2 THEN 'id_whitespace' WHEN 3 THEN 'missing_attr' WHEN 5 THEN 'duplicate_attr' END, 'block', seq, image FROM known WHERE a IN (1, 2, 3, 5)
UNION ALL SELECT 'error', 'extra_attr', 'note', seq, image FROM known WHERE a = 4
UNION ALL SELECT 'warning', 'attr_order', '', seq, image FROM known WHERE a = 6 AND area UNION ALL SELECT 'error', 'bad_enum', 'cover', seq, image FROM known WHERE a = 7 AND area)
SELECT image, seq, severity, code, detail FROM i""",
)
def shape_issues(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    c, a = (k % 12).cast("int"), (F.floor(k / 12) % 8).cast("int")
    pick = lambda rows, i, of: F.get(F.array(*(F.array(*(of(x) for x in r)) for r in rows)), i)
    pair = lambda nv: F.struct(F.lit(nv[0]).alias("name"), F.lit(nv[1]).alias("value"))
    label = F.when(c == 8, "line").when(c == 9, "spot").when(c == 10, "blob").otherwise("area")
    kind = F.when(c.isin(8, 11), "polyline").when(c == 9, "box").otherwise("polygon")
    attributes = F.filter(pick(_NAMES, a, pair), lambda x: (c <= 7) | (x["name"] != "cover"))
    shapes = t.part.select((k % 40).alias("image"), k.alias("seq"), label.alias("label"), kind.alias("kind"), F.when(k % 5 == 0, "auto").otherwise("manual").alias("source"), pick(_POINTS, c, lambda v: F.lit(float(v))).alias("points"), attributes.alias("attributes"))
    return H.shape_issues(shapes, LABELS, side=100.0, least_area=4.0, least_length=2.0, source="manual")


@query(
    "image_issues",
    "WITH i AS (SELECT p_partkey AS k, 'b' || p_partkey % 9 || '_r001_c' || CASE WHEN p_partkey % 7 = 0 THEN '2' ELSE '002' END || CASE WHEN p_partkey % 11 = 0 THEN '.png' ELSE '.tif' END || p_partkey % 1 AS n FROM part), j AS (SELECT k, substr(n, 1, length(n) - 1) AS image FROM i) SELECT image, 'image_size' AS code FROM j WHERE k % 13 = 0 UNION ALL SELECT image, 'image_name_invalid' FROM j WHERE k % 7 = 0 OR k % 11 = 0",
)
def image_issues(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("b"), k % 9, F.lit("_r001_c"), F.when(k % 7 == 0, "2").otherwise("002"), F.when(k % 11 == 0, ".png").otherwise(".tif"))
    return H.image_issues(t.part.select(name.alias("image"), F.lit(1024).alias("width"), F.when(k % 13 == 0, 1000).otherwise(1024).alias("height")), side=1024)


_PARTS = f"""o AS ({_TRUE}), l AS (SELECT a.k AS a, b.k AS b FROM o a JOIN o b ON a.tile = b.tile AND a.k <> b.k AND pow(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)), 2) + pow(greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)), 2) <= 1600),
r(node, reach) AS (SELECT k, k FROM o UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach), c AS (SELECT node, min(reach) AS part FROM r GROUP BY 1),
parts AS (SELECT tile, part, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM o JOIN c ON c.node = o.k GROUP BY 1, 2)"""


def _parts(t: Tables) -> DataFrame:
    return B.outline_parts(_true(t), "tile", "k", cell=64, reach=40.0)


@query("outline_parts", f"WITH RECURSIVE {_PARTS} SELECT * FROM parts")
def outline_parts(t: Tables) -> DataFrame:
    return _parts(t)


_BLOCKS = """every AS (SELECT c_custkey % 13 AS tile, c_custkey % 40 AS sheet, 'canopy' AS kind, CAST(c_custkey % 7 + 1 AS DOUBLE) AS area, 0.0::DOUBLE AS length FROM customer UNION ALL SELECT s_suppkey % 12, s_suppkey % 40, 'piece', 0, s_suppkey % 50 + 3 FROM supplier UNION ALL SELECT c_custkey % 11, c_custkey % 35, 'interrow', c_custkey % 5 + 2, 0 FROM customer WHERE c_custkey % 3 = 0),
per AS (SELECT tile, count(*) FILTER (kind = 'piece') AS n_row_pieces, count(*) FILTER (kind = 'canopy') AS n_canopies, count(DISTINCT sheet) AS n_tiles, sum(length) AS row_length, sum(CASE WHEN kind = 'canopy' THEN area ELSE 0 END) AS canopy_area, sum(CASE WHEN kind = 'interrow' THEN area ELSE 0 END) AS interrow_area FROM every GROUP BY 1),
step AS (SELECT tile, lead(p) OVER (PARTITION BY tile ORDER BY p) - p AS s FROM (SELECT DISTINCT s_suppkey % 12 AS tile, CAST((s_suppkey * 13) % 101 AS DOUBLE) AS p FROM supplier WHERE s_suppkey % 12 > 2 OR s_suppkey < 20)),
rows_ AS (SELECT tile, count(*) AS n_rows, median(s) AS spacing_med FROM step GROUP BY 1), blocks AS (SELECT per.*, coalesce(n_rows, 0) AS n_rows, spacing_med FROM per LEFT JOIN rows_ USING (tile))"""


def _blocks(t: Tables) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    canopies = t.customer.select((c % 13).alias("tile"), (c % 40).alias("sheet"), (c % 7 + 1).alias("area"))
    lanes = t.customer.where(c % 3 == 0).select((c % 11).alias("tile"), (c % 35).alias("sheet"), (c % 5 + 2).alias("area"))
    pieces = t.supplier.select((s % 12).alias("tile"), (s % 40).alias("sheet"), (s % 50 + 3).alias("length"))
    rows = t.supplier.where((s % 12 > 2) | (s < 20)).select((s % 12).alias("tile"), ((s * 13) % 101).cast("double").alias("position")).distinct()
    return B.block_table(canopies, pieces, lanes, rows, "tile", "sheet")


@query(
    "block_table",
    f"""WITH RECURSIVE {_PARTS}, {_BLOCKS}, g AS ({_GATE}),
near AS (SELECT DISTINCT tile FROM parts a JOIN g b ON b.passage % 8 = 6 AND pow(greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)), 2) + pow(greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)), 2) <= 25)
SELECT blocks.*, near.tile IS NOT NULL AND n_rows <= 5 AS is_garden FROM blocks LEFT JOIN near ON near.tile = blocks.tile""",
)
def block_table(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    gates = t.nation.where(n % 8 == 6).select((n * 16).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (n * 16 + 4).cast("double").alias("x1"), F.lit(400.0).alias("y1"))
    return B.gardens(_blocks(t), _parts(t), gates, "tile", cell=64, near=5.0, most_rows=5)


@query("block_issues", f"WITH RECURSIVE {_PARTS}, {_BLOCKS} SELECT tile, 'block_split' AS code, CAST(count(*) AS INTEGER) AS detail FROM parts GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT tile, 'block_too_few_rows', CAST(n_rows AS INTEGER) FROM blocks WHERE n_rows < 4")
def block_issues(t: Tables) -> DataFrame:
    return B.block_issues(_blocks(t), _parts(t), "tile", least_rows=4)


_SPANS = "SELECT {k} % 25 AS b, {k} AS k, CAST(({k} * 7) % 400 AS DOUBLE) / 4 + {off} AS position, CAST({k} % 40 AS DOUBLE) AS x0, CAST({k} % 40 + 60 + {k} % 7 AS DOUBLE) AS x1 FROM {of}"


@query(
    "span_matches",
    f"""WITH p AS ({_SPANS.format(k='p_partkey', off='0.0::DOUBLE', of='part')}), r AS ({_SPANS.format(k='s_suppkey', off='0.25::DOUBLE', of='supplier')}),
j AS (SELECT p.b, p.k AS p, r.k AS q, (least(p.x1, r.x1) - greatest(p.x0, r.x0)) / greatest(p.x1 - p.x0, r.x1 - r.x0) AS cover FROM p JOIN r ON p.b = r.b AND abs(p.position - r.position) <= 1.5),
o AS (SELECT *, row_number() OVER (PARTITION BY b, p ORDER BY cover DESC, q) AS x, row_number() OVER (PARTITION BY b, q ORDER BY cover DESC, p) AS y FROM j WHERE cover >= 0.6) SELECT b, p, q, cover FROM o WHERE x = 1 AND y = 1""",
)
def span_matches(t: Tables) -> DataFrame:
    def spans(df: DataFrame, key: str, off: float) -> DataFrame:
        k = F.col(key)
        return df.select((k % 25).alias("b"), k.alias("k"), (((k * 7) % 400).cast("double") / 4 + off).alias("position"), (k % 40).cast("double").alias("x0"), (k % 40 + 60 + k % 7).cast("double").alias("x1"))

    return B.span_matches(spans(t.part, "p_partkey", 0.0), spans(t.supplier, "s_suppkey", 0.25), "b", "k", tol=1.5, least=0.6)
