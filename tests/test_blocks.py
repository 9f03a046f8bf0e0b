"""Shape checks and blocks by hand-made cases: nulls, empty lists, ties, empty tables."""

from pyspark.sql import functions as F

from fieldlark.operators import blocks as B
from fieldlark.operators import shapes as H

SHAPES = "image int, seq int, label string, kind string, source string, points array<double>, attributes array<struct<name:string,value:string>>"
LABELS = {"area": H.Label("polygon", ("block",), {}), "spot": H.Label("box", ("block",), {})}
CHECKS = dict(side=100.0, least_area=1.0, least_length=2.0, source="manual")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_shapes_with_nulls_spikes_and_touching_corners(spark):
    named = [("block", "V1")]
    square = [1.0, 1.0, 1.0, 5.0, 5.0, 5.0, 5.0, 1.0]
    rows = [
        (1, 1, "area", "polygon", "manual", square, named),
        (1, 2, None, "polygon", "manual", square, named),
        (1, 3, "area", None, "manual", square, named),
        (1, 4, "area", "polygon", "manual", None, None),
        (1, 5, "area", "polygon", "manual", [1.0, 1.0, 1.0, 9.0, 1.0, 5.0, 5.0, 1.0], named),  # turns back
        (1, 6, "area", "polygon", "manual", [0.0, 0.0, 0.0, 4.0, 4.0, 4.0, 0.0, 2.0, 4.0, 0.0], named),  # a corner on another side
        (1, 7, "spot", "box", "manual", [1.0, 1.0], named),
        (1, 8, "area", "polygon", "manual", square, [("block", None)]),
    ]
    got = {(r.seq, r.code) for r in H.shape_issues(spark.createDataFrame(rows, SHAPES), LABELS, **CHECKS).collect()}
    assert got == {(2, "unknown_label"), (3, "wrong_shape"), (4, "missing_attr"), (4, "too_few_vertices"), (5, "invalid_geometry"), (6, "invalid_geometry"), (7, "box_degenerate"), (8, "empty_id")}
    assert H.shape_issues(spark.createDataFrame([], SHAPES), LABELS, **CHECKS).count() == 0


def test_outline_parts_of_blocks_far_apart_and_without_a_name(spark):
    of = "b string, k int, x0 double, y0 double, x1 double, y1 double"
    rows = [("V1", 1, 0.0, 0.0, 1.0, 1.0), ("V1", 2, 4.0, 5.0, 6.0, 6.0), ("V1", 3, 30.0, 0.0, 31.0, 1.0), ("V2", 4, 1.0, 1.0, 2.0, 2.0), (" ", 5, 0.0, 0.0, 1.0, 1.0), (None, 6, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, of)
    parts = B.outline_parts(df, "b", "k", cell=8, reach=5.0)  # 3 across and 4 up: exactly 5
    assert rows_of(parts.select("b", "part", "n")) == [("V1", 1, 2), ("V1", 3, 1), ("V2", 4, 1)]
    assert B.outline_parts(df.limit(0), "b", "k", cell=8, reach=5.0).count() == 0


def test_block_table_of_one_layer_only(spark):
    none = spark.createDataFrame([], "b string, t int, area double")
    pieces = spark.createDataFrame([("V1", 1, 4.0), ("V1", 2, 6.0), (None, 1, 9.0)], "b string, t int, length double")
    rows = spark.createDataFrame([("V1", 2.0)], "b string, position double")
    got = B.block_table(none, pieces, none, rows, "b", "t").collect()
    assert [(r.b, r.n_rows, r.n_row_pieces, r.n_tiles, r.row_length, r.canopy_area, r.spacing_med) for r in got] == [("V1", 1, 2, 2, 10.0, 0.0, None)]


def test_span_matches_ties_and_empty_spans(spark):
    of = "g int, k int, position double, x0 double, x1 double"
    pred = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0), (1, 2, 0.5, 0.0, 10.0), (1, 3, 9.0, 5.0, 5.0), (None, 4, 0.0, 0.0, 9.0)], of)
    ref = spark.createDataFrame([(1, 7, 0.2, 0.0, 10.0), (1, 8, 9.0, 5.0, 5.0), (None, 9, 0.0, 0.0, 9.0)], of)
    assert rows_of(B.span_matches(pred, ref, "g", "k", tol=1.0, least=0.8)) == [(1, 1, 7, 1.0)]
    assert B.span_matches(pred, ref.where(F.lit(False)), "g", "k", tol=1.0, least=0.8).count() == 0
