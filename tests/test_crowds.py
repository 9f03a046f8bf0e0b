"""Nearest points, edits, spans, parts, passages and covered lengths where many rows lie at few places or close together."""

import random

from pyspark.sql import functions as F

from fieldlark.operators import blocks as B
from fieldlark.operators import graph as G
from fieldlark.operators import links as L
from fieldlark.operators import reports as R
from fieldlark.operators import spatial as P
from fieldlark.operators import spanning as S

BOX = "x0 double, y0 double, x1 double, y1 double"


def captured(monkeypatch, module, name):
    """Row counts of what a module's step is given first."""
    seen, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda a, *x, **y: seen.append(a.count()) or real(a, *x, **y))
    return seen


def broadcasts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_nearest_widens_only_for_points_not_settled(spark, monkeypatch):
    r = random.Random(1)
    left = [(k, r.choice([None, *map(float, range(6))]), r.randint(0, 400) / 10) for k in range(300)]
    right = [(k, float(r.randint(0, 5)), r.randint(0, 200) / 10) for k in range(400)]
    want = {k: min(((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in right if x is not None and ((x - a) ** 2 + (y - b) ** 2) ** 0.5 <= 5), default=(None, None)) for k, x, y in left}
    seen = captured(monkeypatch, P, "within_distance")
    got = P.nearest(spark.createDataFrame(left, "k int, x double, y double"), spark.createDataFrame(right, "r int, x double, y double"), "k", "r", limit=5)
    rows = got.collect()
    assert {x.k: x.r for x in rows} == {k: j for k, (_, j) in want.items()} and len(rows) == 300
    assert all(abs((x.distance or 0) - (want[x.k][0] or 0)) < 1e-9 for x in rows)
    assert len(seen) > 1 and seen[-1] < seen[0]
    assert P.nearest(spark.createDataFrame(left, "k int, x double, y double"), spark.createDataFrame([], "r int, x double, y double"), "k", "r", limit=5).where("r is null").count() == 300


def test_edits_meet_the_least_row_of_a_position_only(spark, monkeypatch):
    seen, real = [], L._near
    monkeypatch.setattr(L, "_near", lambda a, b, *x: seen.append((a.count(), b.count())) or real(a, b, *x))
    rows = spark.createDataFrame([(k % 2, k, float(k % 6 // 2 * 10), 5.0, 9.0) for k in range(300)], f"b int, k int, v double, x0 double, x1 double")
    edits = spark.createDataFrame([(k % 2, 1000 + k, float(k % 4), float(k % 3), 12.0, "extend") for k in range(200)] + [(0, 2000, 21.0, 0.0, 1.0, "delete")], "b int, k int, v double, x0 double, x1 double, kind string")
    got = {x.k: (x.x0, x.x1, x.action) for x in L.edit_rows(rows, edits, tile="b", row="k", at="v", start="x0", stop="x1", kind="kind", tol=4.0).collect()}
    assert seen == [(5, 6)]
    assert len(got) == 299 and 4 not in got and got[0] == (0.0, 12.0, "extended") and got[1] == (0.0, 12.0, "extended")
    assert all(got[k] == (5.0, 9.0, "kept") for k in range(300) if k not in (0, 1, 4))


def test_pairs_of_positions_send_no_side_through_the_driver(spark):
    rows = spark.createDataFrame([(1, k, float(k % 50), 0.0, 5.0) for k in range(300)], "b int, k int, v double, x0 double, x1 double")
    assert broadcasts(L._near(rows, rows, ["b"], "v", 2.0)) == 0


def test_components_send_no_table_through_the_driver(spark):
    got = G.components(spark.createDataFrame([(k, k + 7) for k in range(300)], "a long, b long"))
    assert broadcasts(got) == 0 and got.select("component").distinct().count() == 7


def test_equal_spans_meet_once(spark):
    span = "b int, k int, position double, x0 double, x1 double"
    p = spark.createDataFrame([(0, k, float(k % 3 * 5), 0.0, 10.0) for k in range(300)], span)
    q = spark.createDataFrame([(0, k, float(k % 3 * 5) + 0.5, 1.0, 10.0) for k in range(270)], span)
    got = B.span_matches(p, q, "b", "k", tol=1.0, least=0.6)
    assert sorted((x.p, x.q) for x in got.collect()) == [(0, 0), (1, 1), (2, 2)]
    from test_copies import rows_of_joins

    assert rows_of_joins(got) <= 3


def test_parts_of_copies_meet_once(spark, monkeypatch):
    r = random.Random(2)
    at = [(float(x), float(y), x + 3.0, y + 2.0) for x, y in ((r.randint(0, 60), r.randint(0, 60)) for _ in range(9))]
    rows = [(k % 2, k, *r.choice(at)) for k in range(200)]
    seen = captured(monkeypatch, B, "box_join")
    got = {(x.tile, x.part, x.n) for x in B.outline_parts(spark.createDataFrame(rows, f"tile int, k int, {BOX}"), "tile", "k", cell=16, reach=5.0).collect()}
    part = {k: k for _, k, *_ in rows}
    gap = lambda a, b: max(0, max(a[0], b[0]) - min(a[2], b[2])) ** 2 + max(0, max(a[1], b[1]) - min(a[3], b[3])) ** 2
    for _ in range(9):
        for t, k, *a in rows:
            part[k] = min(part[j] for u, j, *b in rows if t == u and gap(a, b) <= 25)
    assert got == {(t, part[k], sum(part[j] == part[k] for j in part)) for t, k, *_ in rows}
    assert seen[0] <= 18


def test_blocks_bring_their_passages_along(spark):
    rows = [(k, float(k % 10 * 4), 0.0, float(k % 10 * 4 + 2), 5.0) for k in range(120)]
    gates = [(7, 9.0, 0.0, 10.0, 9.0), (8, 30.0, 0.0, 31.0, 2.0)]
    through = lambda b, g: b[1] - 3 <= g[3] and g[1] <= b[3] + 3
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and max(0, max(a[1], b[1]) - min(a[3], b[3])) < 3 and not any(through(a, g) and through(b, g) for g in gates)}
    got = R.close_blocks(spark.createDataFrame(rows, f"k int, {BOX}"), "k", cell=16, gap=3, passages=spark.createDataFrame(gates, f"passage int, {BOX}"))
    assert {tuple(x) for x in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 0


def test_boxes_that_touch_along_are_one(spark):
    boxes = spark.createDataFrame([(float(k % 40), 0.0, float(k % 40 + 3), 2.0) for k in range(400)] + [(90.0, 0.0, 91.0, 2.0), (5.0, 5.0, 1.0, 6.0)], BOX)
    assert sorted(map(tuple, S.merged_along(boxes).collect())) == [(0.0, 0.0, 42.0, 2.0), (5.0, 5.0, 1.0, 6.0), (90.0, 0.0, 91.0, 2.0)]
    lines = spark.createDataFrame([(1, -10.0, 1.0, 100.0, 1.0), (2, 10.0, -2.0, 10.0, 2.0), (3, 0.0, 0.0, 60.0, 2.0)], f"k int, {BOX}")
    got = {x.k: (round(x.length, 6), round(x.outside, 6)) for x in S.outside_lengths(lines, boxes, "k").collect()}
    assert got[1] == (110.0, 67.0) and got[2] == (4.0, 2.0) and abs(got[3][1] / got[3][0] - 0.3) < 1e-6


def test_lists_of_copies_are_made_once(spark):
    areas = spark.createDataFrame([(k, 0.0, 0.0, 10.0, 10.0) for k in range(100)] + [(200, 50.0, 0.0, 60.0, 9.0)], f"a int, {BOX}")
    parcels = spark.createDataFrame([(f"Z{k}", "st"[k % 2], 1.0, 1.0, 5.0, 5.0) for k in range(100)] + [("Y", "s", 58.0, 1.0, 61.0, 5.0)], f"p string, kind string, {BOX}")
    got = P.overlap_shares(areas, parcels, "a", "p", "kind", cell=8, least_area=2, least_share=0.5)
    rows = {x.a: x for x in got.collect()}
    assert len(rows) == 101 and rows[200].kinds == "s=1" and rows[5].kinds == "s=50;t=50" and rows[5].parcel_ids == ";".join(sorted(f"Z{k}" for k in range(100)))
    from test_copies import rows_of_joins

    assert rows_of_joins(got) <= 101


def test_adjacent_rows_are_adjacent_pairs_without_pairs_by_the_middle(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(r.randint(0, 1), k, r.choice([None, *map(float, range(0, 60, 2))]), float(x), x + float(r.randint(1, 30))) for k, x in ((k, r.randint(0, 60)) for k in range(240))], "b2 int, k int, v double, x0 double, x1 double")
    want = L.adjacent_pairs(L.neighbour_pairs(rows, block="b2", row="k", at="v", start="x0", stop="x1", pitch=10.0, line=2.0, gap=40.0))
    got = L.adjacent_rows(rows, block="b2", row="k", at="v", start="x0", stop="x1", pitch=10.0, line=2.0)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert L.adjacent_rows(rows.limit(0), block="b2", row="k", at="v", start="x0", stop="x1", pitch=10.0, line=2.0).count() == 0


def test_thinned_rows_meet_those_that_stay_only(spark, monkeypatch):
    from fieldlark.operators import matching as M
    from fieldlark.session import Steps

    met, put = [], Steps.put
    monkeypatch.setattr(Steps, "put", lambda self, name, df: met.append((name, (out := put(self, name, df)).count())) or out)
    r = random.Random(9)
    rows = [(0, k, r.random() * 4, r.random() * 4) for k in range(800)]
    kept = []
    for g, k, x, y in rows:
        if all(((x - a) ** 2 + (y - b) ** 2) ** 0.5 >= 2 for _, a, b in kept):
            kept.append((k, x, y))
    got = M.dedupe(spark.createDataFrame(rows, "g int, k int, x double, y double"), "g", ["k"], ["x", "y"], limit=2.0)
    assert sorted(x.k for x in got.collect()) == [k for k, *_ in kept]
    assert max(n for _, n in met) <= 800  # pairs of rows in reach would be over 100,000


def test_a_rest_of_few_links_is_settled_whatever_other_pieces_there_are(spark, monkeypatch):
    from fieldlark.operators import unions as U

    pieces = spark.createDataFrame([(k, k % 3, 0.0, 9.0) for k in range(60)], "piece long, tile long, low double, high double")
    links = spark.createDataFrame([(0, 1, 1.0, 1), (1, 2, 2.0, 2), (2, 3, 3.0, 3)], "a long, b long, cost double, link long")
    calls, real = [], U._one_by_one
    monkeypatch.setattr(U, "_one_by_one", lambda overlap: calls.append(1) or real(overlap))
    got = {x.piece: x.chain for x in U.chains(pieces, links, overlap=1.0, settle=10).collect()}
    assert got == {k: 0 if k < 3 else k for k in range(60)} and calls
