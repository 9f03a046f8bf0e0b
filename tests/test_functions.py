import pytest
from pyspark.sql import functions as F

from fieldlark.functions import numbers as N
from fieldlark.functions import text as X


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_text(spark):
    L = F.lit
    r = one(
        spark, X.text_or_none(L("  a ")), X.text_or_none(L(" nan ")), X.normalize_enum(L(" Semi-Bare "), ["semi_bare"]), X.normalize_enum(L("disr"), ["disrupted"], {"disr": "disrupted"}),
        X.is_valid_id(L("V01-R002"), "row"), X.is_valid_id(L("V01-R02"), "row"), X.row_index_of(L("V01-R017")), X.row_index_of(L("V01")),
        X.parse_tile_id(L("site_r021_c006")), X.merge_flags(L("a; b"), L("b;c"), L(None).cast("string")), X.format_fixed(L(-0.001), 2), X.format_fixed(L(None).cast("double"), 2),
        X.parse_area_ha(L("0.12 ha")), X.parse_rle(L("1, 2,3")), X.rle_to_mask(F.array(L(1), L(2))), X.normalize_landuse(L("Viţă   de VIE")),
    )
    assert list(r)[:8] == ["a", None, "semi_bare", "disrupted", True, False, 17, None]
    assert tuple(r.c8) == (21, 6) and r.c9 == "a;b;c" and r.c10 == "0.00" and r.c11 == "" and r.c12 == 0.12
    assert r.c13 == [1, 2, 3] and r.c14 == [False, True, True] and r.c15 == "viță de vie"


def test_natural_order(spark):
    names = ["V01-R10", "V01-R9", "V2", "V10", "", None, "a1b", "a1a", "a01"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "s string").orderBy(X.natural_key(F.col("s")), "s").collect()]
    assert got.index("V01-R9") < got.index("V01-R10") and got.index("V2") < got.index("V10") and got.index("a1a") < got.index("a1b")


def test_numbers(spark):
    L = F.lit
    r = one(
        spark, N.round_up(L(2.5)), N.round_up(L(-2.5)), N.share(L(1.0), L(3.0)), N.share(L(1.0), L(0.0)), N.f1_from_counts(L(0), L(0), L(0)), N.relative_error(L(0.0), L(0.0)), N.relative_error(L(1.0), L(0.0)),
        N.axial_deg(L(-1.0), L(0.0)), N.axial_deg(L(1.0), L(1.0)), N.axial_difference(L(179.0), L(1.0)), N.cover_class(L(0.25), L(0.0), L(1.0)), N.structure_of_gap(L(5.0), L(0.5)),
        N.priority(L("gap"), L(10.0)), N.bin_index(L(-1.0), [0, 1, 2]), N.bin_index(L(9.0), [0, 1, 2]), N.bin_index(L(1.0), [0, 1, 2]),
    )
    assert list(r) == [3.0, -2.0, 0.3333, 0.0, 1.0, 0.0, float("inf"), 0.0, 45.0, -2.0, "mixed", "disrupted", 2, 0, 1, 1]


def test_geometry_columns(spark):
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 3), (0, 3)]))
    r = one(spark, N.ring_area(pts), N.line_length(pts), N.point_in_ring(F.lit(1.0), F.lit(1.0), pts), N.point_in_ring(F.lit(5.0), F.lit(1.0), pts), F.size(N.drop_repeated_points(F.concat(pts, F.slice(pts, 4, 1)))), N.polygon_area(F.array(pts, pts)))
    assert list(r) == [12.0, 11.0, True, False, 4, 0.0]
    box = lambda *v: [F.lit(float(x)) for x in v]
    r = one(spark, N.box_iou(box(0, 0, 2, 2), box(1, 0, 3, 2)), N.clip_box(box(0, 0, 2, 2), box(5, 5, 6, 6)), N.tile_of_point(F.lit(51.2), F.lit(-51.2), 0.0, 0.0), F.size(N.tiles_of_box(F.lit(0.0), F.lit(-60.0), F.lit(60.0), F.lit(0.0), 0.0, 0.0)), N.encode_height(F.lit(0.0)))
    assert r.c0 == pytest.approx(1 / 3) and r.c1 is None and tuple(r.c2) == (1, 1) and r.c3 == 4 and r.c4 == [1, 134, 160]
