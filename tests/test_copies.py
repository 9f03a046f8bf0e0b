"""Joins and selections over many copies of few places: same rows as pair by pair, work by places."""

import random

from pyspark.sql import functions as F

from fieldlark.operators import matching as M
from fieldlark.operators import spatial as P
from fieldlark.operators import survey as V
from fieldlark.operators.graph import components

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(r, n, places):
    at = [(x, y, x + r.randint(2, 4), y + r.randint(2, 4)) for x, y in ((r.randint(0, 20), r.randint(0, 20)) for _ in range(places))]
    return [(k, *map(float, r.choice(at))) for k in range(n)]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i) if i else 0.0


def rows_of_joins(df):
    """Rows that leave the joins of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif "Join" in name:
            out = max(out, p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_best_block_searches_places_not_rows(spark):
    r = random.Random(1)
    a, b = [(*x[:1], *x[1:]) for x in boxes(r, 600, 5)] + [(900, None, 1.0, 2.0, 3.0)], boxes(r, 400, 4)
    want = {}
    for k, *p in a:
        best = None
        for j, *q in b if None not in p else ():
            o = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
            d = (max(0, max(p[0], q[0]) - min(p[2], q[2])) ** 2 + max(0, max(p[1], q[1]) - min(p[3], q[3])) ** 2) ** 0.5
            if d <= 2:
                best = min(best or (1e9,), (-o, d, j))
        want[k] = best and best[2]
    got = P.best_block(spark.createDataFrame(a, f"k int, {BOX}"), spark.createDataFrame(b, f"block int, {BOX}"), "k", "block", cell=8, limit=2.0)
    assert {x.k: x.block for x in got.collect()} == want
    assert rows_of_joins(got) <= 601


def _of_copies(spark):
    r = random.Random(2)
    left, right = [(k % 2, *x) for x in boxes(r, 120, 9) for k in x[:1]], boxes(r, 60, 7)
    return spark.createDataFrame(left, f"tile int, k long, {BOX}"), spark.createDataFrame(right, f"k long, {BOX}")


def test_greedy_match_of_copies_lists_no_pairs(spark):
    left, right = _of_copies(spark)
    pairs = P.iou_pairs(left, right, cell=8).select(F.col("l_tile").alias("tile"), F.col("l_k").alias("l"), F.col("r_k").alias("r"), F.col("iou").alias("score"))
    got = M.match_boxes(left, right, "tile", "k", "k", cell=8, least=0.1)
    assert sorted(got.collect()) == sorted(M.match(pairs, "tile", "l", "r", "score", least=0.1).collect())
    assert rows_of_joins(got) <= 240
    assert M.match_boxes(left.limit(0), right, "tile", "k", "k", cell=8, least=0.1).count() == 0


def test_optimal_match_of_copies_lists_no_pairs(spark):
    left, right = _of_copies(spark)
    pairs = P.iou_pairs(left, right, cell=8).select(F.col("l_tile").alias("tile"), F.col("l_k").alias("l"), F.col("r_k").alias("r"), F.col("iou").alias("score"))
    total = lambda rows: {g: (sum(x.tile == g for x in rows), round(sum(x.score for x in rows if x.tile == g), 6)) for g in (0, 1)}
    got = M.match_boxes(left, right, "tile", "k", "k", cell=8, least=0.1, method="optimal")
    rows = got.collect()
    assert total(rows) == total(M.match(pairs, "tile", "l", "r", "score", least=0.1, method="optimal").collect())
    assert {tuple(x) for x in rows} <= {tuple(x) for x in pairs.collect()}
    assert len({(x.tile, x.l) for x in rows}) == len(rows) == len({(x.tile, x.r) for x in rows})
    assert rows_of_joins(got) <= 240


def test_suppress_lets_only_the_first_copy_meet_others(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k % 2, k, r.choice([None, 1.0, 2.0]), *b) for k, *b in boxes(r, 400, 12)] + [(0, 900, 5.0, 3.0, 3.0, 3.0, 9.0), (0, 901, 5.0, 3.0, 3.0, 3.0, 9.0)]
    kept = []
    for t, k, rank, *b in sorted(rows, key=lambda x: (-(x[2] if x[2] is not None else float("-inf")), x[1])):
        if all(t != u or iou(b, c) <= 0.2 for u, _, c in kept):
            kept.append((t, k, b))
    met = []
    monkeypatch.setattr(M, "iou_pairs", lambda a, b, *x, **y: met.append(a.count()) or P.iou_pairs(a, b, *x, **y))
    got = M.suppress(spark.createDataFrame(rows, f"tile int, k int, rank double, {BOX}"), "tile", "k", "rank", limit=0.2, cell=8)
    assert sorted(x.k for x in got.where("kept").collect()) == sorted(k for _, k, _ in kept)
    assert met[0] <= 24


def test_place_links_connect_the_same_blocks(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(f"V{k}", *b) for k, *b in boxes(r, 200, 8)], f"block string, {BOX}")
    groups = lambda links: {(x.node, x.component) for x in components(links.select("a", "b"), df.select(F.col("block").alias("node"))).collect()}
    few = V.place_links(df, "block", gap_m=2.0, cell=16)
    assert groups(few) == groups(V.block_links(df, "block", gap_m=2.0, always_m=0.5, cell=16))
    assert few.count() <= 200 + 8 * 8


def test_copy_pairs_are_iou_pairs_without_measuring_copies(spark):
    r = random.Random(8)
    a = spark.createDataFrame(boxes(r, 700, 2) + [(990, None, 0.0, 1.0, 1.0)], f"k int, {BOX}").withColumn("s", F.col("k") * 2)
    b = spark.createDataFrame(boxes(r, 90, 5), f"k int, {BOX}")
    got, want = P.copy_pairs(a, b, "k", cell=8), P.iou_pairs(a, b, cell=8)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    assert rows_of_joins(got) <= 700


def test_contested_pairs_bring_their_support(spark):
    pairs = spark.createDataFrame([(1, 2, 3.0, 4.0), (1, 3, None, 0.0), (5, 4, 2.0, None), (2, 1, None, None)], "a int, b int, sa double, sb double")
    assert sorted(map(tuple, V.contest(pairs).collect())) == [(1, 2), (2, 1), (3, 1), (4, 5)]


def test_ids_per_kind_beyond_six_digits_as_the_sql_cuts_them(spark, tmp_path):
    import duckdb
    from compare import assert_same

    from fieldlark.plans import catalog

    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, 'view' AS event_type, TIMESTAMP '2024-01-01' + to_seconds(i % 977) AS ts FROM range(1000050) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    last = catalog.QUERIES["per_kind_ids"](spark, str(tmp_path)).where("number > 999990")
    assert_same(last, con, f"SELECT * FROM ({catalog.ORACLES['per_kind_ids']}) WHERE number > 999990")
