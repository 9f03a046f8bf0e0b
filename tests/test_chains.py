import numpy as np

from fieldlark.operators import chains as C
from fieldlark.operators import geometry as Y
from fieldlark.plans import views as V


def test_chains(spark):
    rows, a, b = [1, 2, 3, 1, 2, 4], [0, 1, 2, 50, 51, 0], [5, 6, 7, 60, 60, 5]
    assert C.longest_chains(rows, a, b, width=2, least_rows=2) == [[0, 1, 2, 5], [3, 4]]
    df = spark.createDataFrame([("V1", *r) for r in zip(rows, map(float, a), map(float, b))], "block string, row int, a double, b double")
    got = C.cross_paths(df, "block", "row", "a", "b", width=2, least_rows=2)
    assert sorted((r.path, r.row) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]
    assert C.constrained_groups(4, [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 0.5)], ["x", "y", "x", "y"]) == [[0, 1], [2, 3]]
    p = spark.createDataFrame([("g", i, t) for i, t in enumerate("xyxy")], "g string, piece int, tile string")
    q = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 2.0), ("g", 2, 3, 0.5)], "g string, a int, b int, cost double")
    assert sorted((r.chain, r.piece) for r in C.chains_of(p, q, "g", "piece", "tile").collect()) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    assert C.merge_angles([10.0, 179.0, 1.0, 12.0], 5.0) == [0, 1]
    assert C.drop_runs([1, 5, 4, 9], [True, True, False, True], 7) == [3]


def test_paths():
    region = [[Y.box_ring(0, 0, 10, 10)], [Y.box_ring(20, 0, 30, 10)]]
    line = np.array([[5.0, 5.0], [25.0, 5.0], [25.0, 20.0]])
    assert np.allclose(C.outside_lengths(line, region), [10, 10])
    zigzag = np.array([[1.0, 1], [2, 5], [3, 1], [4, 5], [9, 9]])
    assert C.string_pull(zigzag, set(), region[:1]) == [0, 4] and C.string_pull(zigzag, {2}, region[:1]) == [0, 2, 4]
    assert C.covered(line, np.array([[5.0, 6.5], [5, 9]]), 2.0).tolist() == [True, False]


def test_views(spark, sf_dir):
    V.register_tables(spark, sf_dir, ["nation", "region"])
    V.register_query(spark, sf_dir, "two_level_sums", "sums")
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25
    assert spark.table("sums").count() > 0
    n = spark.table("nation")
    assert V.visible(n, n.n_regionkey.cast("string"), "1", admin=False).count() < 25 == V.visible(n, n.n_regionkey, None, admin=True).count()
    assert V.public(n, ["n_name"]).columns == ["n_nationkey", "n_regionkey"]
    t = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, None, 1)], "id int, who string, at int")
    assert sorted((r.id, r.was, r.now) for r in V.assignment_notices(t, "id", "who", "at").collect() if r.was) == [(1, "a", "b")]
