import json

import numpy as np
from pyspark.sql import functions as F

from fieldlark.functions import projection as J
from fieldlark.operators import survey as V


def test_projection():
    lon, lat = np.array([27.0, 28.8, 25.1, 27.0]), np.array([47.0, 46.5, 47.9, 0.0])
    e, n = J.to_grid(lon, lat, 35)
    assert abs(e[0] - 500000) < 1e-6 and abs(n[3]) < 1e-6 and 5.20e6 < n[0] < 5.21e6
    back = J.to_degrees(e, n, 35)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9


def test_rows_to_targets(spark):
    pts = spark.createDataFrame([("r1", float(x)) for x in (0.5, 1.5, 2.5, 9.5, 12.5, 40.5)], "row string, at double")
    rows = spark.createDataFrame([("r1", 41.0), ("r2", 3.0)], "row string, length double")
    prof = V.occupancy_profile(pts, rows, "row", "at", "length", bin_m=1.0)
    assert prof.count() == 44
    gaps = V.profile_gaps(prof, "row", bin_m=1.0)
    got = sorted((r.row, r.gap_start, r.gap_stop, r.kind) for r in gaps.collect())
    assert got == [("r1", 3.0, 9.0, "interior"), ("r1", 10.0, 12.0, "interior"), ("r1", 13.0, 40.0, "interior"), ("r2", 0.0, 3.0, "full")]
    s = {r.row: (r.max_gap, r.n_gaps, r.structure) for r in V.row_structure(prof, "row", bin_m=1.0).collect()}
    assert s == {"r1": (27.0, 2, "disrupted"), "r2": (0.0, 0, "regular")}
    t = sorted((r.target_id, r.start, r.stop, r.priority) for r in V.gap_targets(gaps.where("row = 'r1'"), "row").collect())
    assert t == [("G-00001", 13.0, 26.5, 1), ("G-00002", 26.5, 40.0, 1), ("G-00003", 3.0, 9.0, 2), ("M-00001", 10.0, 12.0, 3)]


def test_farms(spark):
    blocks = spark.createDataFrame([("V10", 0.0, 0.0, 10.0, 10.0, 100.0), ("V9", 14.0, 0.0, 20.0, 10.0, 60.0), ("V2", 100.0, 0.0, 110.0, 10.0, 100.0), ("V3", 115.0, 0.0, 120.0, 10.0, 50.0)], "block string, x0 double, y0 double, x1 double, y1 double, area double")
    road = spark.createDataFrame([(112.0, -50.0, 113.0, 50.0)], "x0 double, y0 double, x1 double, y1 double")
    links = V.block_links(blocks, "block", gap_m=10, always_m=0.5, cell=32, barriers=road)
    assert [(r.a, r.b, r.gap) for r in links.collect()] == [("V10", "V9", 4.0)]
    f = V.farms(blocks, links, "block", "area")
    assert sorted((r.farm_id, r.blocks) for r in f.collect()) == [("F01", "V2"), ("F02", "V3"), ("F03", "V9,V10")]
    assert {r.block: r.farm_id for r in V.farm_of_block(f).collect()}["V10"] == "F03"
    doc = json.loads(V.document({"farms": f, "links": links}, {"farms": ["farm_id"], "links": ["a", "b"]}).first()[0])
    assert doc["farms"][0]["farm_id"] == "F01" and doc["links"][0]["gap"] == 4.0
    assert V.order_blocks(blocks, "x0", "y0", "block").where("block_no = 1").first().block == "V10"


def test_walks(spark):
    edges = spark.createDataFrame([(10.0, 1.0), (10.0, 0.5)], "length_m double, inside_frac double")
    assert [r.cost for r in V.apply_policy(edges, penalty=4.0).orderBy("cost").collect()] == [10.0, 30.0]
    assert V.apply_policy(edges, penalty=4.0, most_outside=1.0).count() == 1
    legs = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0, 0.0), (2, 3.0, 4.0, 0.0, 0.0, 0.05)], "seq int, x0 double, y0 double, x1 double, y1 double, outside_m double")
    r = V.route_checks(legs, spark.createDataFrame([("a", 1.0), ("b", 9.0)], "target_id string, visit_dist_m double")).first()
    assert r.length == 10.0 and r.ok and r.covered == 1 and r.zero_legs == 0
    pairs = spark.createDataFrame([("V1", 1, 2), ("V1", 2, 3), ("V1", 1, 3)], "block string, i int, j int")
    assert [x.interrow_id for x in V.interrow_ids(pairs, "block", "i", "j").orderBy(F.col("k")).collect()] == ["V1-I001", "V1-I002", "V1-I003"]
