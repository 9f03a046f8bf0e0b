"""Links by hand-made cases: ties, nulls, empty tables."""

from pyspark.sql import functions as F

from fieldlark.operators import links as L


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_link_pieces_ties_nulls_and_other_tiles(spark):
    rows = spark.createDataFrame([(1, 0, 10, 7), (1, 0, 10, 5), (1, 1, 30, 8), (None, 0, 1, 9)], "b int, t int, v long, k int")
    pieces = spark.createDataFrame([(1, 0, 20, 1), (1, 0, 10, 2), (1, 2, 40, 3), (None, 0, 5, 4), (1, 0, None, 5)], "b int, t int, v long, p int")
    got = {r.p: (r.left, r.right) for r in L.link_pieces(pieces, rows, block="b", tile="t", at="v", piece="p", row="k").where("p < 4").collect()}
    assert got == {1: (5, 8), 2: (None, 8), 3: (8, None)}
    assert L.link_pieces(pieces, rows.limit(0), block="b", tile="t", at="v", piece="p", row="k").where("left IS NOT NULL").count() == 0


def test_split_edges_merges_close_cuts_and_keeps_whole_edges(spark):
    edges = spark.createDataFrame([(1, 100.0), (2, 8.0)], "e int, n double")
    cuts = spark.createDataFrame([(1, 3.0), (1, 50.0), (1, 50.0), (1, 54.0), (1, 97.0), (2, 4.0), (3, 1.0), (None, 2.0)], "e int, x double")
    assert rows_of(L.split_edges(edges, cuts, edge="e", length="n", at="x", merge=5.0)) == [
        (1, 1, 0.0, 50.0, "1:a", "1:1"), (1, 2, 50.0, 100.0, "1:1", "1:b"), (2, 1, 0.0, 8.0, "2:a", "2:b"),
    ]


def test_candidate_sets_takes_three_a_side_or_one_spur(spark):
    near = [(1, n, 0, 0.1 * n, False) for n in range(1, 6)] + [(1, 9, 1, 1.9, True), (2, 4, 0, 3.0, False), (2, 5, 0, 4.0, True), (3, 4, 1, 2.5, False), (4, 1, 0, 9.0, True)]
    got = rows_of(L.candidate_sets(spark.createDataFrame(near, "t int, n int, s int, d double, m boolean"), target="t", node="n", side="s", distance="d", must="m", reach=5.0, close=1.9))
    assert got == [("1,2,3,9", 1, 1, True), ("4", 2, 2, True)]


def test_lattice_residuals_of_a_shifted_row(spark):
    rows = spark.createDataFrame([(0, float(i * 3) + (0.5 if i == 4 else 0.0), i) for i in range(9)] + [(1, 7.0, 99)], "b int, v double, k int")
    got = {r.k: r.residual for r in L.lattice_residuals(rows, "b", "v", "k", pitch=3.0, half=2).collect()}
    assert abs(got[4] - 0.5) < 1e-9 and abs(got[0]) < 1e-9 and got[99] is None


def test_adjacent_pairs_leave_out_what_a_row_divides(spark):
    rows = spark.createDataFrame([(0, k, 2.5 * k, 0.0, 50.0) for k in range(4)] + [(0, 9, 7.5, 60.0, 80.0), (0, 8, None, 0.0, 1.0)], "g int, k int, v double, x0 double, x1 double")
    pairs = L.neighbour_pairs(rows, block="g", row="k", at="v", start="x0", stop="x1", pitch=2.5, line=0.5, gap=20.0)
    assert rows_of(pairs) == [(0, 0, 1, "parallel"), (0, 0, 2, "skip"), (0, 1, 2, "parallel"), (0, 1, 3, "skip"), (0, 2, 3, "parallel"), (0, 3, 9, "collinear")]
    assert sorted((r.a, r.b) for r in L.adjacent_pairs(pairs).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_edit_rows_delete_wins_and_far_edits_do_nothing(spark):
    of = "t int, k int, v double, x0 double, x1 double"
    rows = spark.createDataFrame([(0, 1, 10.0, 5.0, 9.0), (0, 2, 20.0, 5.0, 9.0), (1, 3, 10.0, 5.0, 9.0)], of)
    edits = spark.createDataFrame([(0, 50, 11.0, 0.0, 9.0, "extend"), (0, 51, 15.0, 0.0, 0.0, "delete"), (0, 52, 20.5, 4.0, 30.0, "extend"), (1, 53, 90.0, 0.0, 0.0, "delete"), (1, 54, 1.0, 2.0, 3.0, "add")], of + ", kind string")
    by = dict(tile="t", row="k", at="v", start="x0", stop="x1", kind="kind", tol=6.0)
    assert rows_of(L.edit_rows(rows, edits, **by)) == [(0, 2, 20.0, 4.0, 30.0, "extended"), (1, 3, 10.0, 5.0, 9.0, "kept"), (1, 54, 1.0, 2.0, 3.0, "added")]
    assert L.edit_rows(rows, edits.limit(0), **by).where("action = 'kept'").count() == 3


def test_threshold_falls_back_to_all_negatives(spark):
    scores = spark.createDataFrame([(0.6, 0), (0.9, 1)], "s double, y int")
    by = dict(score="s", margin=0.1, least=0.5)
    assert abs(L.calibrated_threshold(scores, negative=F.col("y") == 0, survives=F.lit(False), **by).first()[0] - 0.7) < 1e-12
    assert L.calibrated_threshold(scores.limit(0), negative=F.col("y") == 0, survives=F.lit(True), **by).first()[0] is None
