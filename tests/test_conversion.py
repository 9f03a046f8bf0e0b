"""Documents to layers and back: an exact round trip, and each issue."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlark.operators import geometry as Y
from fieldlark.operators import layers as L
from fieldlark.sources import conversion as C
from fieldlark.sources import files as S

TILES = [("site_r000_c000", 1000.0, 5000.0, 0.5), ("site_r001_c002", 2024.0, 3976.0, 0.5), ("site_r002_c000", 1000.0, 2952.0, 0.5)]
SCHEMA = "tile string, width int, height int, seq int, kind string, label string, points array<double>, attributes map<string,string>"


def convert(spark, rows, **more):
    tiles = spark.createDataFrame(TILES, "tile_id string, x0 double, y0 double, gsd_m double")
    return tiles, *C.document_objects(spark.createDataFrame(rows, SCHEMA), tiles, **more)


def ring(data):
    kind, parts = Y.from_wkb(bytes(data))
    return {tuple(p) for p in (parts if kind == "line" else parts[0])}


def shape(tile, seq, kind, label, points, **attributes):
    return (TILES[tile][0], 2048, 2048, seq, kind, label, points, attributes)


ROWS = [
    shape(0, 0, "polyline", "row", [0.0, 0.0, 6.0, 8.0], vineyard_id="V01", row_id="V01-R001", row_structure="regular"),
    shape(0, 1, "polyline", "row", [0.0, 0.0, 0.0, 8.0, 0.0, 8.0, 9.5, 8.0], vineyard_id="V01", row_id="V01-R001", row_structure="disrupted"),
    shape(0, 2, "polygon", "vineyard", [10.0, 10.0, 20.0, 10.0, 20.0, 30.0], vineyard_id="V01"),
    shape(1, 0, "polygon", "vineyard", [2040.0, 5.0, 2047.5, 5.0, 2047.5, 9.0, 2040.0, 9.0], vineyard_id="V02"),
    shape(1, 1, "polygon", "interrow_area", [1.0, 1.0, 5.0, 1.0, 5.0, 5.0], vineyard_id="V02", interrow_cover="bare"),
    shape(1, 2, "box", "waste", [7.0, 3.0, 9.0, 8.0], vineyard_id=""),
    shape(0, 3, "box", "waste", [9.0, 8.0, 7.0, 3.0], vineyard_id="V01"),
    shape(0, 4, "box", "waste", [1.0, 2.0, 3.0, 8.0], vineyard_id="V01"),
]


def test_layers_and_back(spark, tmp_path):
    tiles, objects, issues = convert(spark, ROWS)
    assert [tuple(r)[1:4] for r in issues.collect()] == [("geom_repaired", TILES[0][0], "waste[3]")]
    layers = {k: L.validate_layer(L.coerce_layer(df, L.layer(k, provenance=True)), L.layer(k, provenance=True)) for k, df in C.to_layers(objects, source="manual", run_id="r1").items()}
    assert sorted((r.piece_id, r.length_m) for r in layers["row_pieces"].collect()) == [("V01-R001@site_r000_c000", 5.0), ("V01-R001@site_r000_c000#2", 8.75)]
    assert sorted((r.canopy_id, r.area_m2, r.n_vertices, r.is_clump, r.touches_edge) for r in layers["canopies"].collect()) == [("site_r000_c000:C0001", 25.0, 3, True, False), ("site_r001_c002:C0001", 7.5, 4, True, True)]
    assert [(r.piece_id, r.area_m2, r.interrow_cover) for r in layers["interrow_pieces"].collect()] == [("site_r001_c002:I001", 2.0, "bare")]
    assert sorted((r.waste_id, r.px_xtl, r.px_ytl, r.vineyard_id) for r in layers["waste"].collect()) == [("W0001", 1.0, 2.0, "V01"), ("W0002", 7.0, 3.0, "V01"), ("W0003", 7.0, 3.0, "")]
    for df in (layers["canopies"], layers["interrow_pieces"], layers["waste"]):
        assert all(Y.ring_area(Y.from_wkb(bytes(r.geometry))[1][0]) > 0 for r in df.collect())

    shapes = C.to_shapes(layers, tiles).withColumn("width", F.lit(2048)).withColumn("height", F.lit(2048))
    S.write_annotations(shapes, str(tmp_path / "out"))
    back = S.read_annotations(spark, [str(tmp_path / "out")])
    again = back.select(F.regexp_replace("image", r"\.tif$", "").alias("tile"), "width", "height", "seq", F.col("shape").alias("kind"), "label", F.coalesce("box", "points").alias("points"), "attributes")
    _, second, none = convert(spark, again.collect())
    assert none.count() == 0
    key = lambda df: sorted((r.tile_id, r.label, sorted(map(tuple, ring(r.geometry))), r.vineyard_id, r.row_id or "", r.row_structure or "", r.interrow_cover or "") for r in df.collect())
    assert key(second) == key(objects)


def test_issues(spark):
    rows = [
        shape(0, 0, "polygon", "row", [0.0, 0.0, 6.0, 8.0]),
        shape(0, 1, "polyline", "row", [0.0, 0.0, 60.0, 8.0], vineyard_id=" V01 ", row_structure="Dis-rupted"),
        shape(0, 2, "polyline", "row", [0.0, 0.0, 0.1, 0.1], vineyard_id="V01", row_id="V01-R001", row_structure="whole"),
        shape(0, 3, "polygon", "vineyard", [0.0, 0.0, 5.0, 5.0, 0.0, 0.0], vineyard_id="V01"),
        shape(0, 4, "polygon", "interrow_area", [0.0, 0.0, 5.0, 0.0, 5.0, 5.0, 0.0, 0.0], vineyard_id="V01", interrow_cover=" Bare"),
        shape(0, 5, "box", "waste", [3.0, 3.0, 3.0, 9.0]),
        shape(0, 6, "polyline", "row", None, vineyard_id="V01", row_id="x", row_structure="regular"),
        (TILES[0][0], 2048, 2048, 7, None, None, None, None),
    ]
    _, objects, issues = convert(spark, rows, synonyms={"whole": "regular"})
    got = {}
    for r in issues.collect():
        got.setdefault(r.object_id, set()).add((r.severity, r.code))
    assert got == {
        "row[0]": {("error", "schema_violation")},
        "row[1]": {("warning", "id_whitespace"), ("error", "missing_attr"), ("error", "bad_enum")},
        "row[2]": {("warning", "enum_normalized"), ("error", "geom_dropped")},
        "vineyard[3]": {("error", "geom_dropped")},
        "interrow_area[4]": {("warning", "enum_normalized")},
        "waste[5]": {("error", "geom_dropped")},
        "row[6]": {("error", "geom_dropped")},
        "null[7]": {("error", "schema_violation")},
    }
    assert [(r.seq, r.n_vertices, r.measure, r.interrow_cover) for r in objects.collect()] == [(4, 3, 3.125, "bare")]
    for bad in ([("nowhere", 2048, 2048, 0, "box", "waste", [1.0, 1.0, 2.0, 2.0], None)], [(TILES[0][0], 100, 2048, 0, "box", "waste", [1.0, 1.0, 2.0, 2.0], None)]):
        with pytest.raises(Exception, match="no such tile or size"):
            convert(spark, bad)[1].collect()


def test_empty(spark):
    tiles, objects, issues = convert(spark, [])
    layers = C.to_layers(objects, source="manual", run_id="r1")
    assert issues.count() == sum(df.count() for df in layers.values()) == C.to_shapes(layers, tiles).count() == 0


def test_forms_by_arrays_and_one_by_one():
    """F24"""
    r = np.random.default_rng(4)
    at = lambda n: [float(v) for v in r.integers(0, 4, n)]  # noqa: E731 small numbers, so points repeat
    rows = [(k, at(n) + ([r.random()] if n % 3 == 0 else []), 1000.0 + n, 5000.0, 0.3) for k in ("polyline", "polygon", "box", None) for n in (0, 2, 4, 6, 6, 8, 10, 12, 40, 41) for _ in range(30)]
    rows += [("polygon", None, 1.0, 2.0, 0.5), ("box", [1.0, float("nan"), 2.0, 3.0], 1.0, 2.0, 0.5), ("polyline", [0.0, 0.0, float("nan"), 1.0, 2.0, 2.0], 1.0, 2.0, 0.5)]
    got = C._batch_forms(*(pd.Series(c, dtype=object if i < 2 else float) for i, c in enumerate(zip(*rows))))
    assert got == [C._form(*row) for row in rows] and len({g[1] for g in got}) > 8


def test_forms_are_made_once(spark):
    """layers and issues read what was made, they don't make it again."""
    tiles, objects, issues = convert(spark, ROWS)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (issues, *C.to_layers(objects, source="manual", run_id="r1").values())]
    assert not [p for p in plans if "Python" in p]
