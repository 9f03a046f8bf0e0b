"""Cuts at necks against a pixel-by-pixel version."""

import math
import random
from collections import defaultdict

import pytest

from fieldlark.operators import labelling as L
from fieldlark.operators import necks as N


def plants(seed):
    """Rows of discs that touch, at several slants; some too short, one without necks, one round."""
    r, out = random.Random(seed), set()
    for k in range(9):
        x, y, a = 30, 60 * k - 100, (k - 4) * 0.15
        for _ in range(r.randrange(1, 8)):
            wide = r.randrange(4, 9)
            out |= {(x + i, y + j) for i in range(-wide, wide + 1) for j in range(-wide, wide + 1) if i * i + j * j <= wide * wide}
            step = r.randrange(wide, 2 * wide + 2)
            out |= {(x + i, y + round(i * math.tan(a)) + j) for i in range(step + 1) for j in (-1, 0, 1)}
            x, y = x + step, y + round(step * math.tan(a))
    return out | {(300 + i, j) for i in range(90) for j in range(7)} | {(300 + i, 40 + j) for i in range(20) for j in range(20)}


def cut(place, how):
    n = len(place)
    x0, y0 = min(x for x, _ in place), min(y for _, y in place)
    wide, high = max(x for x, _ in place) + 1 - x0, max(y for _, y in place) + 1 - y0
    if max(wide, high) < how.along / 2**0.5 or n < 2 * how.part:
        return {}
    mx, my = sum(x for x, _ in place) / n, sum(y for _, y in place) / n
    sxx, syy, sxy = (sum((p[i] - m[i]) * (p[j] - m[j]) for p in place for m in [(mx, my)]) for i, j in ((0, 0), (1, 1), (0, 1)))
    turn = 0.5 * math.atan2(2 * sxy, sxx - syy)
    c, s = (math.floor(f(turn) * 2**20 + 0.5) for f in (math.cos, math.sin))
    low = min(x * c + y * s for x, y in place)
    of = {(x, y): (x * c + y * s - low) // (how.slice_px << 20) for x, y in place}
    size = [0] * (max(of.values()) + 1)
    for k in of.values():
        size[k] += 1
    if len(size) * how.slice_px < how.along:
        return {}
    w = [sum(size[max(0, i - 1) : i + 2]) for i in range(len(size))]
    m, r = how.apart, how.reach
    scored = [(w[i] / min(max(w[max(0, i - r) : i]), max(w[i + 1 : i + 1 + r])), i) for i in range(m, len(w) - m) if w[i] == min(w[max(0, i - m) : i + m + 1])]
    taken = []
    for depth, i in sorted(scored):
        if depth <= how.ratio and all(abs(i - j) >= m for j in taken):
            taken.append(i)
    taken.sort()
    if any(sum(size[a + 1 : b]) < how.part for a, b in zip([-1, *taken], [*taken, len(size)])):
        return {}
    return {p: k for p, k in of.items() if k in taken}


@pytest.mark.parametrize("seed, how", [(1, N.Necks(24, 0.8, 6, 14, 12)), (2, N.Necks(30, 0.6, 10, 20, 60, 3)), (3, N.Necks(16, 0.95, 2, 30, 1))])
def test_against_one_by_one(spark, seed, how):
    frame = spark.createDataFrame([("m", x, y) for x, y in plants(seed)], "layer string, x long, y long").repartition(4)
    labelled = L.label_runs(L.pixel_runs(frame, ["layer"], block=32), ["layer"], diagonal=True)
    places = defaultdict(set)
    for r in labelled.collect():
        places[r.place] |= {(x, r.y) for x in range(r.x0, r.x1)}
    want = {k: cut(p, how) for k, p in places.items()}
    got = defaultdict(set)
    for r in N.necks(labelled, how)[0].collect():
        got[r.place].add(r.slice)
    assert dict(got) == {k: set(v.values()) for k, v in want.items() if v}
    assert got
    after = defaultdict(set)
    for r in N.split_at_necks(labelled, how, ["layer"], diagonal=True).collect():
        after[r.place] |= {(x, r.y) for x in range(r.x0, r.x1)}
    assert set().union(*after.values()) == set().union(*places.values()) - {p for v in want.values() for p in v}
    assert len(after) >= len(places) + len({(k, i) for k, v in want.items() for i in v.values()})


def test_blocks_and_empty(spark):
    how = N.Necks(24, 0.9, 6, 14, 5)
    r = random.Random(5)
    profile = spark.createDataFrame([(p, i, r.randrange(1, 9)) for p in (1, 2) for i in range(200)], "place long, slice long, n long")
    wide, narrow = ({tuple(x) for x in N.valleys(profile, how, block=b).collect()} for b in (4096, 16))
    assert wide == narrow and wide
    taken = N.spread(N.valleys(profile, how), how.apart)
    assert {tuple(x) for x in N.whole_parts(profile, taken, 3, block=16).collect()} == {tuple(x) for x in N.whole_parts(profile, taken, 3).collect()} == {tuple(x) for x in taken.collect()}
    empty = L.label_runs(L.pixel_runs(spark.createDataFrame([], "x long, y long")))
    assert N.split_at_necks(empty, how).count() == 0
    with pytest.raises(ValueError):
        N.Necks(24, 1.5, 6, 14, 5)


def test_necks_bear_their_pixels(spark):
    """counts come from the profile; no pixel is met again."""
    how = N.Necks(24, 0.8, 6, 14, 12)
    labelled = L.label_runs(L.pixel_runs(spark.createDataFrame(sorted(plants(1)), "x long, y long")))
    cuts, pixels = N.necks(labelled, how)
    want = {(r.place, r.slice): r["count"] for r in pixels.groupBy("place", "slice").count().collect()}
    rows = cuts.collect()
    assert rows and all(r.n == want[r.place, r.slice] for r in rows)
