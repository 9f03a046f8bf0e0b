import random

from pyspark.sql import functions as F

from fieldlark.operators import graph as G


def labels_of(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_long_chain(spark):
    chain = spark.range(50_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    r = G.components(chain).agg(F.count_distinct("component").alias("c"), F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("component").alias("label")).first()
    assert (r.c, r.n, r.label) == (1, 50_001, r.least)


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(5, 5), (1000, 1000)] + [(2000, 2000 + i) for i in range(300)] + [(4000, 3000 + i) for i in range(300)]
    df = spark.createDataFrame(edges * 2, "a long, b long").repartition(7)
    assert {r.node: r.component for r in G.components(df).collect()} == labels_of(edges)
    names = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "a string, b string")
    assert {r.node: r.component for r in G.components(names).collect()} == labels_of([(f"n{a}", f"n{b}") for a, b in edges])


def test_components_of_no_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert G.components(none).count() == 0
    assert [tuple(r) for r in G.components(none, spark.createDataFrame([(3,)], "node long")).collect()] == [(3, 3)]


def test_rounds_without_local_stars(spark, monkeypatch):
    """The alternation alone, as where links of a component never share a partition."""
    monkeypatch.setattr(G, "_local_stars", lambda links: links)
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    assert {r.node: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()} == labels_of(edges)
