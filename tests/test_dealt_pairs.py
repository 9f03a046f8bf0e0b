"""Joins by cells whose few rows are many pairs: tasks are dealt by pairs, crowded cells in slices."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import matching as M
from fieldlark.operators import quadtree as Q
from fieldlark.operators import spanning as S
from fieldlark.operators import spatial as P

BOX = "k int, x0 double, y0 double, x1 double, y1 double"


def most_in_a_task(pairs):
    return pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("n_left, n_right", [(120, 120), (2, 4000), (4000, 2)])
def test_crowd_of_boxes_is_sliced(spark, monkeypatch, n_left, n_right):
    """F19, F27"""
    monkeypatch.setattr(Q, "TRIED", 1000, raising=False)
    r = random.Random(n_left)
    crowd = lambda n, far: [(k, *((5.0, 5.0, 9.0, 9.0) if k < n - far else (float(x := r.randint(50, 90)), 60.0, x + 3.0, 63.0))) for k in range(n)]
    left, right = crowd(n_left, 1), crowd(n_right, 1)
    want = {(a[0], b[0]) for a in left for b in right if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    got = P.box_join(spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX)).select("l_k", "r_k")
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert most_in_a_task(got) <= 5000 < len(want) or len(want) < 5000


def test_crowd_of_points_is_sliced(spark, monkeypatch):
    """F23"""
    monkeypatch.setattr(Q, "TRIED", 1000, raising=False)
    points = [(k, None if k == 7 else k % 5 / 10, 0.5) for k in range(150)]
    df = spark.createDataFrame(points, "k int, x double, y double")
    got = P.within_distance(df, df, limit=0.2).select("l_k", "r_k", "distance")
    want = {(a, b) for a, x, _ in points for b, u, _ in points if x is not None and u is not None and abs(x - u) <= 0.2}
    rows = got.collect()
    assert len(rows) == len(want) and {(x.l_k, x.r_k) for x in rows} == want
    assert most_in_a_task(got) <= 5000 < len(want)


def test_connectors_and_decisions_of_crowds(spark, monkeypatch):
    """the same rows however tasks are dealt."""
    stops = spark.createDataFrame([(k // 3, k % 3 * 10, float(k * 7 % 20), float(k % 11)) for k in range(90)], "line int, at int, x double, y double")
    boxes = spark.createDataFrame([(k, k % 2, float(k % 3), 0.0, float(k % 3 + 5), 4.0) for k in range(80)], "k int, tile int, x0 double, y0 double, x1 double, y1 double")
    calls = boxes.where("k % 3 = 0").withColumnRenamed("k", "line").withColumn("decision", F.when(F.col("line") % 2 == 0, "reject").otherwise("add"))
    found = []
    for tried in (10**9, 200):
        monkeypatch.setattr(Q, "TRIED", tried, raising=False)
        merged = M.merge_decisions(boxes, calls, "tile", "k", "line", "decision", least=0.5)
        found.append((sorted(map(tuple, S.plan_connectors(stops, reach=8.0).collect())), sorted(map(tuple, merged.collect()))))
    assert found[0] == found[1] and all(found[0])


def test_decisions_of_one_place_meet_once(spark, monkeypatch):
    """copies add no pairs; the last line of all copies holds; null boxes and tiles match nothing; keys that repeat share what matches one of them."""
    tried, whole = [], M.iou_pairs

    def counted(*args, **more):
        pairs = whole(*args, **more)
        tried.append(pairs.count())
        return pairs

    monkeypatch.setattr(M, "iou_pairs", counted)
    r = random.Random(27)
    place = lambda: (r.choice([0, 1, None]), float(r.randrange(3)), 0.0, *r.choice([(6.0, 4.0), (7.0, 4.0), (None, 4.0)]))
    boxes = [(k // 2 if k < 20 else k, *place()) for k in range(300)]
    calls = [(k, *place(), r.choice(["reject", "accept", "add", "other"])) for k in range(200)]
    columns = "tile int, x0 double, y0 double, x1 double, y1 double"
    got = M.merge_decisions(spark.createDataFrame(boxes, f"k int, {columns}"), spark.createDataFrame(calls, f"line int, {columns}, decision string"), "tile", "k", "line", "decision", least=0.8)

    def same(a, b):
        if None in a or None in b or a[0] != b[0]:
            return False
        inter = max(0, min(a[3], b[3]) - max(a[1], b[1])) * 4
        return inter > 0 and inter / (4 * (a[3] - a[1] + b[3] - b[1]) - inter) >= 0.8

    hits = [(b[0], c[0], c[6]) for b in boxes for c in calls if same(b[1:], c[1:6])]
    last = {k: d for k, _, d in sorted(hits, key=lambda h: h[1])}
    want = [(b[1], str(b[0]), *b[2:], "confirmed" if b[0] in last else "auto") for b in boxes if last.get(b[0]) != "reject"]
    want += [(c[1], f"manual-{c[0]}", *c[2:6], "manual") for c in calls if c[6] in ("accept", "add") and c[0] not in {h[1] for h in hits}]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {x[-1] for x in want} == {"auto", "confirmed", "manual"}
    assert tried[0] <= (2 * 3 * 2) ** 2 < len(hits)


def test_overlaps_of_crowds_are_dealt_and_given_out_once(spark, monkeypatch, tmp_path):
    """F2 of round 4"""
    from fieldlark.plans.catalog import QUERIES

    monkeypatch.setattr(Q, "TRIED", 20, raising=False)
    r = random.Random(3)
    parts = [(300 * i + r.choice([*range(0, 60, 3), 50]), r.choice([5, 6])) for i in range(400)]
    lines = [(r.choice(parts[:200])[0],) for _ in range(300)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    box = lambda k, s: (k % 100, s, k % 100 + 1 + k % 3, s + 2)
    rank = {k: (-sum(x == k for x, in lines), k) for k, _ in parts}
    want = []
    for i, p in enumerate(parts):
        for q in parts[:i]:
            a, b = box(*p), box(*q)
            if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                winner, loser = sorted((p[0], q[0]), key=rank.get)
                want.append((loser, winner))
    got = QUERIES["cut_overlaps"](spark, str(tmp_path))
    assert sorted(tuple(x) for x in got.select("loser", "winner").collect()) == sorted(want)
    assert most_in_a_task(got) < len(want) / 3


def test_crowd_pairs_are_iou_pairs(spark):
    r = random.Random(8)
    at = [(0.0, 0.0, 9.0, 3.0), (2.0, 1.0, 3.0, 9.0), (9.0, 0.0, 12.0, 3.0), (5.0, 5.0, 5.0, 8.0), (None, 1.0, 2.0, 3.0), (20.0, 20.0, 22.0, 23.0)]
    rows = [(None if k % 50 == 9 else k // 2 if k % 7 == 0 else k, f"n{k}", *r.choice(at)) for k in range(200)]
    df = spark.createDataFrame(rows, BOX.replace("k int", "k int, name string"))
    cols = ["overlap", "iou"]
    want = P.iou_pairs(df, df, cell=4).where("l_k < r_k").select("l_k", "l_name", "r_k", "r_name", *cols)
    got = P.crowd_pairs(df, "k", cell=4)
    swap = F.col("l_k") < F.col("r_k")
    got = got.select(*(F.when(swap, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{a}_{c}") for a, b in (("l", "r"), ("r", "l")) for c in ("k", "name")), *cols)
    rows = sorted(tuple(x) for x in got.collect())
    assert rows == sorted(tuple(x) for x in want.collect()) and len(rows) > 1000
    assert P.crowd_pairs(df.limit(0), "k", cell=4).count() == 0
