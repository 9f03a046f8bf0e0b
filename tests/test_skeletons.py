"""Pruning, merging, coverage and chains under conflicts against one-by-one versions."""

import random
from collections import Counter, defaultdict

import pytest

from fieldlark.operators import skeletons as K
from fieldlark.operators import unions as U


def pruned(branches, least):
    live = list(branches)
    while True:
        deg = Counter(n for _, u, v, _ in live for n in (u, v))
        spur = {b for b, u, v, n in live if u != v and n < least and min(deg[u], deg[v]) == 1 and max(deg[u], deg[v]) >= 3}
        for node, d in deg.items():
            at = [x for x in live if node in x[1:3]]
            if d >= 3 and all(x[0] in spur for x in at):
                spur = spur - {max(at, key=lambda x: (x[3], -x[0]))[0]}
        if not spur:
            return {b for b, *_ in live}
        live = [x for x in live if x[0] not in spur]


def skeleton(seed, n):
    r = random.Random(seed)
    edges = [(k, r.randrange(max(0, k - 4), k), k, r.choice([1.0, 2.0, 5.0, 9.0])) for k in range(1, n)]
    return edges + [(500, 3, 3, 0.5), (501, 1, 2, 0.5)] + [(600 + k, 900, 901 + k, 1.0 + k % 2) for k in range(4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_prune(spark, seed):
    branches = skeleton(seed, 70)
    got = K.prune_spurs(spark.createDataFrame(branches, "branch long, u long, v long, length double"), 3.0)
    assert {r.branch for r in got.collect()} == pruned(branches, 3.0)


def test_merge(spark):
    branches = [(1, 1, 2, 1.0), (2, 3, 2, 2.0), (3, 3, 4, 3.0), (4, 4, 5, 1.0), (5, 4, 6, 1.0), (6, 10, 11, 1.0), (7, 11, 12, 1.0), (8, 12, 10, 1.0), (9, 20, 20, 4.0)]
    got = sorted(tuple(r) for r in K.merged_lines(spark.createDataFrame(branches, "branch long, u long, v long, length double")).collect())
    assert got == [(1, 3, 6.0, 1, 4), (4, 1, 1.0, 4, 5), (5, 1, 1.0, 4, 6), (6, 3, 3.0, None, None), (9, 1, 4.0, 20, 20)]


def test_coverage(spark):
    r = random.Random(3)
    polys = {k: [(r.uniform(-3, 23), r.uniform(-3, 23)) for _ in range(r.randrange(3, 7))] for k in range(4)}
    polys[9] = [(5, 5), (12, 5), (12, 12), (5, 12)]
    edges = [(k, *map(float, p), *map(float, q)) for k, ring in polys.items() for p, q in zip(ring, ring[1:] + ring[:1])]
    edges += [(9, *map(float, p), *map(float, q)) for p, q in zip([(7, 7), (7, 9), (9, 9), (9, 7)], [(7, 9), (9, 9), (9, 7), (7, 7)])]
    got = {(x.j, x.i): x.share for x in K.coverage(spark.createDataFrame(edges, "k int, x0 double, y0 double, x1 double, y1 double"), key="k", width=20, height=20, samples=3).collect()}
    fine = 200
    for j in range(20):
        for i in range(20):
            want = 0.0
            for k in {e[0] for e in edges}:
                for s in range(3):
                    y = j + (s + 0.5) / 3
                    xs = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for q, x0, y0, x1, y1 in edges if q == k and min(y0, y1) <= y < max(y0, y1))
                    want += sum(any(a <= i + (t + 0.5) / fine < b for a, b in zip(xs[::2], xs[1::2])) for t in range(fine)) / fine / 3
            assert got.get((j, i), 0.0) == pytest.approx(min(1.0, want), abs=0.02)


def chained(pieces, links, overlap):
    root, members = {p[0]: p[0] for p in pieces}, {p[0]: [p] for p in pieces}
    for _, _, a, b in sorted((c, k, a, b) for a, b, c, k in links):
        a, b = root[a], root[b]
        if a == b or any(p[1] == q[1] and min(p[3], q[3]) - max(p[2], q[2]) > overlap for p in members[a] for q in members[b]):
            continue
        a, b = min(a, b), max(a, b)
        members[a] += members.pop(b)
        for p in members[a]:
            root[p[0]] = a
    return root


@pytest.mark.parametrize("seed, settle", [(1, 0), (2, 30), (3, 1000), (4, 1000)])
def test_chains(spark, seed, settle):
    r = random.Random(seed)
    pieces = [(k, r.randrange(5), lo := r.randrange(0, 40) / 2, lo + r.randrange(2, 12) / 2) for k in range(30)]
    links = [(r.randrange(30), r.randrange(30), r.randrange(6) / 4, k) for k in range(70)]
    got = U.chains(spark.createDataFrame(pieces, "piece long, tile int, low double, high double"), spark.createDataFrame(links, "a long, b long, cost double, link long"), overlap=0.5, settle=settle)
    assert {x.piece: x.chain for x in got.collect()} == chained(pieces, links, 0.5)


@pytest.mark.parametrize("held, rounds", [(1_000_000, 8), (60, 60)])
def test_chains_of_few_hubs(spark, held, rounds):
    """Links that all meet three chains settle many a round; chains of over ``held`` members settle theirs by both sides."""
    r = random.Random(6)
    pieces = [(k, r.randrange(2) if k % 9 else None, lo := r.randrange(0, 400) / 2, lo + r.randrange(1, 9) / 2 if k % 11 else None) for k in range(120)]
    links = [(k, (k * s) % 3, r.randrange(9) / 4 if k % 40 else None, 2 * k + s - 1) for k in range(3, 120) for s in (1, 2)]
    got = U.chains(spark.createDataFrame(pieces, "piece long, tile int, low double, high double"), spark.createDataFrame(links, "a long, b long, cost double, link long"), overlap=0.5, settle=60, most_rounds=rounds, held=held)
    free = [(p, f"none{p}" if tile is None or high is None else tile, low, high or low) for p, tile, low, high in pieces]
    want = chained(free, [(a, b, -1 if cost is None else cost, link) for a, b, cost, link in links], 0.5)
    assert {x.piece: x.chain for x in got.collect()} == want
    assert max(Counter(want.values()).values()) > 25


def test_registered_chains(spark, sf_dir):
    from fieldlark.plans.catalog import QUERIES

    got = {x.piece: x.chain for x in QUERIES["chained_pieces"](spark, sf_dir).collect()}
    keys = sorted(r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").collect())
    pieces = [(k, k % 7, float(k * 13 % 90), float(k * 13 % 90 + 4 + k % 9)) for k in keys]
    links = [(k, k * s % m + 1, float(k * 7 % 50), k * 2 + j) for k in keys for j, (s, m) in enumerate(((31, 149), (17, 113))) if k * s % m + 1 in set(keys)]
    assert got == chained(pieces, links, 1.0)


def test_chain_over_three_tiles(spark):
    pieces = [(1, 0, 0.0, 10.0), (2, 1, 10.0, 20.0), (3, 2, 20.0, 30.0), (4, 1, 11.0, 19.0), (5, 2, 40.0, 45.0)]
    links = [(1, 2, 0.1, 1), (2, 3, 0.1, 2), (1, 4, 0.05, 3), (4, 3, 0.3, 4), (3, 5, 0.2, 5)]
    got = U.chains(spark.createDataFrame(pieces, "piece long, tile int, low double, high double"), spark.createDataFrame(links, "a long, b long, cost double, link long"), overlap=1.0)
    assert {x.piece: x.chain for x in got.collect()} == {1: 1, 4: 1, 2: 2, 3: 2, 5: 2}
    along = got.join(spark.createDataFrame(pieces, "piece long, tile int, low double, high double"), "piece")
    parts = defaultdict(set)
    for x in U.split_unsupported(along, longest=5.0).collect():
        parts[x.chain, x.part].add(x.piece)
    assert dict(parts) == {(1, 0): {1, 4}, (2, 0): {2, 3}, (2, 1): {5}}
