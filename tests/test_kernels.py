import itertools
import random

import numpy as np
import pytest

from fieldlark.operators import geometry as Y
from fieldlark.operators import graph as G
from fieldlark.operators import matching as M
from fieldlark.operators import raster as R


def boxes(rng, n, size=20):
    a = rng.uniform(0, size, (n, 2))
    return np.hstack((a, a + rng.uniform(1, 6, (n, 2))))


def test_union_area_of_boxes_by_grid():
    rng = np.random.default_rng(1)
    for _ in range(20):
        b = rng.integers(0, 12, (6, 4))
        b = np.hstack((np.minimum(b[:, :2], b[:, 2:]), np.maximum(b[:, :2], b[:, 2:]) + 1))
        grid = np.zeros((14, 14, 2), bool)
        for k, (x0, y0, x1, y1) in enumerate(b):
            grid[y0:y1, x0:x1, k % 2] = True
        polys = [[Y.box_ring(*r)] for r in b.astype(float)]
        u, v, both = Y.boolean_areas(polys[::2], polys[1::2])
        assert (round(u, 6), round(v, 6), round(both, 6)) == (grid[..., 0].sum(), grid[..., 1].sum(), grid.all(2).sum())


def test_union_area_of_triangles_by_sampling():
    rng = np.random.default_rng(2)
    polys = [[rng.uniform(0, 10, (3, 2))] for _ in range(5)]
    p = rng.uniform(0, 10, (200_000, 2))
    share = np.any([Y.inside(p, q) for q in polys], axis=0).mean()
    assert abs(Y.union_area(polys) - 100 * share) < 0.6


def test_polygon_with_hole_and_wkb():
    p = [Y.box_ring(0, 0, 10, 10), Y.box_ring(2, 2, 4, 4)]
    assert Y.polygon_area(p) == 96 and abs(Y.union_area([p]) - 96) < 1e-9
    kind, back = Y.from_wkb(Y.to_wkb("multipolygon", [p, p]))
    assert kind == "multipolygon" and abs(Y.union_area(back) - 96) < 1e-9
    assert abs(abs(Y.ring_area(Y.notch_holes(p))) - 96) < 1e-9
    assert Y.inside(np.array([Y.label_point(p)]), p)[0]


def test_clip_and_lines():
    line = np.array([[-5.0, 5.0], [15.0, 5.0], [15.0, 8.0], [5.0, 8.0]])
    parts = Y.clip_line_to_box(line, (0, 0, 10, 10))
    assert [round(Y.line_length(p), 6) for p in parts] == [10, 5]
    ring = Y.clip_convex(Y.box_ring(-5, -5, 5, 5), Y.box_ring(0, 0, 10, 10))
    assert abs(Y.ring_area(ring)) == 25
    assert len(Y.simplify(np.array([[0, 0], [1, 0.01], [2, 0]]), 0.1)) == 2
    assert Y.cover_share(line[:2], line[:2] + [0, 0.4], 0.5) == 1.0
    assert np.allclose(Y.midline(np.array([[0, 0], [10, 0]]), np.array([[10, 2], [0, 2]]))[:, 1], 1)


@pytest.mark.parametrize("seed", range(8))
def test_matching_by_brute_force(seed):
    rng = random.Random(seed)
    pairs = [(a, b, round(rng.random(), 3)) for a in range(5) for b in range(4) if rng.random() < 0.6]
    if not pairs:
        return
    left, right, score = (np.array(x) for x in zip(*pairs))
    best = (0, 0.0)
    for n in range(1, 5):
        for c in itertools.combinations(range(len(pairs)), n):
            if len({left[i] for i in c}) == n == len({right[i] for i in c}) and all(score[i] >= 0.2 for i in c):
                best = max(best, (n, round(float(sum(score[i] for i in c)), 6)))
    got = M.optimal_pairs(left, right, score, 0.2)
    assert (len(got), round(float(score[got].sum()), 6)) == best


def test_parts():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 9, rng.integers(1, 9)).tolist()
        parts = M.plan_parts(sizes, 10)
        sums = [sum(s for s, p in zip(sizes, parts) if p == k) for k in range(parts[-1] + 1)]
        assert max(sums) <= 10 and len(sums) == M.greedy_count(sizes, 10)
        least = min(c for c in range(1, len(sizes) + 1) for cuts in itertools.combinations(range(1, len(sizes)), c - 1) if all(sum(sizes[a:b]) <= 10 for a, b in zip((0, *cuts), (*cuts, len(sizes)))))
        assert len(sums) == least


def test_thresholds_and_groups():
    assert M.walk_down(0.9, [0.9, 0.8, 0.7], [0.1, 0.5, 0.9], [0, 0, 0], 0.5) == 0.8
    assert M.walk_down(0.9, [0.9, 0.8, 0.7], [0.1, 0.2, 0.9], [0, 0, 1], 0.5) == 0.8
    with pytest.raises(ValueError):
        M.walk_down(0.9, [0.9], [0.1], [1], 0.5)
    assert M.choose_groups({"a": 10, "b": 5, "c": 5, "d": 80}, 0.15, 2) == ("a", "b")


@pytest.mark.parametrize("seed", range(6))
def test_tours(seed):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 100, (9, 2))
    d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
    groups = [[1, 2], [3, 4], [5], [6, 7, 8]]
    total, tour = G.exact_group_tour(d, groups)
    best = min(G.tour_length(d, [0, *perm]) for c in itertools.product(*groups) for perm in itertools.permutations(c))
    assert abs(total - best) < 1e-9 and abs(G.tour_length(d, tour) - total) < 1e-9
    one = G.improve_tour(d, G.nearest_neighbour_tour(d))
    assert sorted(one) == list(range(9)) and G.tour_length(d, one) <= G.tour_length(d, G.nearest_neighbour_tour(d)) + 1e-9
    length, rough = G.group_tour(d, groups, exact_up_to=0)
    assert length >= total - 1e-9 and len(rough) == 5
    assert all(c >= -1e-9 for c in G.insertion_costs(d, [0, 1], [[2], [3]]))


def test_contract_keeps_distances():
    edges = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (3, 0, 9.0), (3, 4, 1.0)]
    assert G.contract(edges, {0, 3, 4}) == [(0, 3, 4.0), (3, 4, 1.0)]


def test_components_and_rings():
    rng = np.random.default_rng(5)
    for connectivity in (4, 8):
        mask = rng.random((20, 20)) < 0.5
        labels, n = R.label_components(mask, connectivity)
        seen, count = np.zeros_like(mask), 0
        near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
        for v, u in np.argwhere(mask):
            if not seen[v, u]:
                count, todo = count + 1, [(v, u)]
                seen[v, u] = True
                while todo:
                    a, b = todo.pop()
                    assert labels[a, b] == labels[v, u]
                    for dv, du in near:
                        c, d = a + dv, b + du
                        if 0 <= c < 20 and 0 <= d < 20 and mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
        assert n == count
    rings = R.outline_rings(mask)
    assert abs(abs(sum(Y.ring_area(r) for r in rings)) - mask.sum()) < 1e-9
    assert (R.rasterize(rings, mask.shape) == mask).all()
    assert R.rle_rings([1, 2, 1, 2], 10, 5, 3, 2)


def test_profiles_and_fits():
    x = np.arange(400) * 0.05
    spacing, snr = R.spacing_of(1 + np.cos(2 * np.pi * x / 2.3), 0.05, 1.0, 4.0)
    assert abs(spacing - 2.3) < 0.06 and snr > 100
    rng = np.random.default_rng(6)
    t = rng.integers(0, 8, 600) * 12.0
    along = rng.uniform(0, 200, 600)
    a = np.radians(33.0)
    pts = np.column_stack((along * np.cos(a) - t * np.sin(a), along * np.sin(a) + t * np.cos(a)))
    assert abs(R.dominant_angle(pts) - 33) < 0.6
    y = 2 * x + 1
    y[::17] += 50
    slope, at = R.huber_line(x, y, 0.1)
    assert abs(slope - 2) < 0.02 and abs(at - 1) < 0.1


def test_masks():
    rgb = np.zeros((12, 12, 3), np.uint8)
    rgb[..., 1] = 200
    rgb[:4, :4] = 0
    valid = R.valid_mask(rgb, most=3, least_pixels=10)
    assert (~valid).sum() == 16
    veg = R.vegetation_mask(rgb, valid, sigma=0, threshold=0.5)
    assert veg.sum() == 144 - 16
    labels, n = R.label_components(veg)
    assert n == 1 and R.label_fractions(veg, labels, n)[0] == 1.0
    assert R.fuse_masks(veg, None, None, "A").sum() == veg.sum() and R.fuse_masks(veg, None, None, "C").sum() == 0
    assert abs(R.gaussian_blur(np.ones((5, 5)), 1.5) - 1).max() < 1e-9
