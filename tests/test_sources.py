import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.operators import geometry as Y
from fieldlark.operators import layers as L
from fieldlark.plans import stages as P
from fieldlark.sources import files as S
from fieldlark.streaming import events as E


def test_layers(spark, tmp_path):
    spec = L.layer("row_pieces")
    g = Y.to_wkb("line", [(0, 0), (3, 4)])
    df = spark.createDataFrame([("p1", "V01-R001", "V01", "site_r001_c002", "regular", 5, 1.5, 2, bytearray(g))], "piece_id string, row_id string, vineyard_id string, tile_id string, row_structure string, length_m int, max_gap_m double, n_vertices long, geometry binary")
    S.write_layer(df, spec, str(tmp_path / "a"))
    back = S.read_layer(spark, spec, str(tmp_path / "a"))
    assert back.select(Y.length_of("geometry")).first()[0] == 5.0
    bad = back.withColumn("row_structure", F.lit("odd"))
    assert [(r.rule, r.column, r.n) for r in L.violations(bad, spec).collect()] == [("enum", "row_structure", 1)]
    with pytest.raises(ValueError):
        L.validate_layer(back.union(back), spec)
    with pytest.raises(Exception, match="lossy"):
        L.coerce_layer(df.withColumn("n_vertices", F.lit(2.5)), spec).collect()
    assert L.empty_layer(spark, L.layer("targets", provenance=True)).count() == 0


def test_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], "a")], "fid long, xy array<array<double>>, name string")
    text = S.geojson_collection(df, "LineString", "xy", ["fid", "name"], "fid", epsg=32635).first()[0]
    (tmp_path / "x.json").write_text(text)
    row = S.read_geojson(spark, str(tmp_path / "x.json"), "fid:bigint,name:string", epsg=32635).first()
    assert (row.kind, json.loads(row.coordinates), row.fid, row.name) == ("LineString", [[1.0, 2.0], [3.0, 4.0]], 1, "a")
    with pytest.raises(Exception, match="unexpected CRS"):
        S.read_geojson(spark, str(tmp_path / "x.json"), "fid:bigint", epsg=4326).collect()
    S.write_geojson_lines(df, "LineString", "xy", ["fid"], str(tmp_path / "lines"))
    assert json.loads(spark.read.text(str(tmp_path / "lines")).first()[0])["properties"] == {"fid": 1}


def test_annotations(spark, tmp_path):
    xml = """<annotations><image id="0" name="t1.tif" width="10" height="10">
<polyline label="row" points="1.00,2.00;3.50,4.00"><attribute name="row_structure"> Regular </attribute></polyline>
<box label="waste" xtl="1" ytl="2" xbr="3" ybr="4"></box><mask label="canopy" rle="1, 2, 1" left="0" top="0" width="2" height="2"></mask></image></annotations>"""
    for n in ("a.xml", "b.xml"):
        (tmp_path / n).write_text(xml)
    shapes = S.read_annotations(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")])
    assert shapes.count() == 6
    last = S.last_copy_wins(shapes, spark.createDataFrame([("a.xml", 1), ("b.xml", 2)], "file string, seq int"))
    assert {r.file for r in last.collect()} == {"b.xml"} and last.count() == 3
    line = last.where("shape = 'polyline'").select("points", S.clean_attribute(F.col("attributes"), "row_structure", ["regular"]).alias("s")).first()
    assert line.points == [1.0, 2.0, 3.5, 4.0] and line.s == "regular"
    S.write_annotations(last.where("shape = 'polyline'").withColumn("seq", F.lit(0)), str(tmp_path / "out"))
    assert 'points="1.00,2.00;3.50,4.00"' in spark.read.text(str(tmp_path / "out")).first()[0]


def test_report(spark, tmp_path):
    rows = [("survey", None, None, 2, 3, 30.0, 0.0, 0.0, 8.0, 0.0, 5, None), ("block", "V01", None, None, 1, 10.004, 0.0, 0.0, 4.0, 0.0, 2, None), ("block", "V02", None, None, 2, 20.0, 0.0, 0.0, 4.0, 0.0, 3, None)]
    df = spark.createDataFrame(rows, "level string, vineyard_id string, row_id string, block_count int, row_count int, row_length_m double, canopy_area_m2 double, canopy_area_ha double, interrow_area_m2 double, interrow_area_ha double, plant_count int, row_structure string")
    S.write_report(df, str(tmp_path / "r"))
    cells = S.read_report(spark, str(tmp_path / "r"))
    assert cells.where("level = 'survey'").first().row_length_m == "30.00"
    assert all(r.ok for r in S.check_report(cells).collect())


def test_archives_masks_json(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.tif", b"abc")
    m = S.list_zip_members(spark, str(tmp_path / "a.zip"))
    assert m.first().size == 3 and S.repeated_members(m.union(m)).count() == 1
    mask = np.random.default_rng(1).random((13, 21)) < 0.5
    assert (S.decode_mask_png(S.encode_mask_png(mask)) == mask).all()
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "i.jpg", "width": 4, "height": 4}], "annotations": [{"id": 7, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "can"}]}))
    r = S.read_coco(spark, str(tmp_path / "c.json")).first()
    assert (r.category, r.x, r.h) == ("can", 1.0, 4.0)
    y = spark.range(1).select(S.yolo_polygons(F.lit("3 0.5 0.5 1 1 0 1\n"), F.lit(10), F.lit(20)).alias("p")).first().p
    assert y[0]["class"] == 3 and [(q.x, q.y) for q in y[0].points] == [(5.0, 10.0), (10.0, 20.0), (0.0, 20.0)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"id": i, "ts": f"2024-01-01T00:{m:02d}:00Z", "k": "a", "v": 1} for i, m in enumerate((0, 1, 30, 31, 59))]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    (src / "2.json").write_text(json.dumps({"id": 9, "ts": "2024-01-02T00:00:00Z", "k": "a", "v": 1}))
    stream = E.read_event_lines(spark, str(src), "id long, ts timestamp, k string, v int")
    for _ in range(2):  # the second call has nothing new
        E.to_folder(E.silences(stream, "ts", "k", gap="10 minutes", late="0 minutes"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = sorted(r.n for r in spark.read.parquet(str(tmp_path / "o")).collect())
    static = spark.read.schema("id long, ts timestamp, k string, v int").json(str(src))
    assert got == [1, 2, 2]
    assert E.windowed(static, "ts", "k", "v", size="1 hour").count() == 2 and E.latest(static, "ts", "k", "v", "id").count() == 1
    known = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert E.changes(spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "k string, v int"), known, "k", "v").count() == 2


def test_stages(spark, tmp_path):
    calls = []
    s = [P.Stage("one", lambda sp, t: (calls.append(1), t["raw"].withColumn("y", F.col("x") + 1))[1], ("raw",), config_keys=("a",)), P.Stage("two", lambda sp, t: t["one"].groupBy().sum("y"), ("one",)), P.Stage("bad", lambda sp, t: 1 / 0, ("raw",)), P.Stage("after", lambda sp, t: t["bad"], ("bad",))]
    raw = spark.createDataFrame([(1,), (2,)], "x int")
    p = P.Pipeline(s, str(tmp_path), {"a": 1})
    tables, report = p.run(spark, {"raw": raw}, {"raw": "v1"})
    assert tables["two"].first()[0] == 5 and report.ran == ["one", "two"] and set(report.failed) == {"bad", "after"}
    _, report = p.run(spark, {"raw": raw}, {"raw": "v1"}, ["one", "two"])
    assert report.cached == ["one", "two"] and len(calls) == 1
    assert p.between("two", "bad") == ["two", "bad"] and P.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
