"""Numbers: rounding laws, shares, scores, class rules. All JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(x: Column, decimals: int = 0) -> Column:
    """Half toward plus infinity; alike in every engine with floor."""
    k = float(10**decimals)
    return F.floor(x * k + 0.5) / k


def round_even(x: Column, decimals: int = 0) -> Column:
    return F.bround(x, decimals)


def share(part: Column, whole: Column, decimals: int = 4) -> Column:
    """part / whole rounded; 0 unless whole is positive."""
    return F.when(whole > 0, round_up(part / whole, decimals)).otherwise(0.0)


def f1_from_counts(tp: Column, n_pred: Column, n_ref: Column) -> Column:
    """2 TP / (P + R); 1 when both are empty."""
    return F.when(n_pred + n_ref == 0, 1.0).otherwise(2.0 * tp / F.greatest(n_pred + n_ref, F.lit(1)))


def relative_error(pred: Column, ref: Column) -> Column:
    """|p - r| / |r|; 0 for 0 against 0, infinite for anything else against 0."""
    return F.when(ref != 0, F.abs(pred - ref) / F.abs(ref)).when(pred == 0, 0.0).otherwise(float("inf"))


def value_score(pred: Column, ref: Column, tol: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - relative_error(pred, ref) / tol)


def structure_of_gap(max_gap: Column, visible: Column, *, gap_m: float = 5.0, least_visible: float = 0.5) -> Column:
    return F.when(visible < least_visible, "unassessable").when(max_gap >= gap_m, "disrupted").otherwise("regular")


def borderline(max_gap: Column, low: float = 4.5, high: float = 7.0) -> Column:
    return max_gap.between(low, high)


def cover_class(veg: Column, shadow: Column, width: Column, *, bare: float = 0.25, full: float = 0.75, most_shadow: float = 0.5, least_width: float = 0.4) -> Column:
    return F.when((shadow > most_shadow) | (width < least_width), "unassessable").when(veg < bare, "bare").when(veg > full, "vegetation").otherwise("mixed")


def priority(kind: Column, gap_m: Column) -> Column:
    """1: waste or a gap over 10 m; 3: missing plants, sparse, other; else 2."""
    return F.when((kind == "waste") | ((kind == "gap") & (gap_m > 10)), 1).when(kind.isin("missing_plant", "sparse", "other"), 3).otherwise(2)


def first_reason(*reasons: Column) -> Column:
    """The first reason that is not null: fit, then hard, then soft rejects."""
    return F.coalesce(*reasons)


def rank_score(base: Column, boost: Column, strength: float) -> Column:
    return base + strength * boost * (1 - base)


def decide(score: Column, margin: Column, *, accept: float, review: float, least_margin: float = 0.0) -> Column:
    return F.when((score >= accept) & (margin >= least_margin), "accept").when(score >= review, "review").otherwise("reject")


def saliency(colour: Column, area: Column, low: float, high: float) -> Column:
    """Colour strength times the log position of the area between two sizes, held in 0..1."""
    at = (F.log(F.greatest(area, F.lit(low))) - F.log(F.lit(low))) / (F.log(F.lit(high)) - F.log(F.lit(low)))
    return colour * F.least(F.lit(1.0), F.greatest(F.lit(0.0), at))


def health_index(disrupted: Column, missing: Column, gap_share: Column, missing_p95: Column, gap_p95: Column, eligible: Column) -> Column:
    """100 (1 - 0.4 d - 0.3 min(1, m/M) - 0.3 min(1, g/G)); null unless eligible."""
    part = lambda x, top: F.when(top > 0, F.least(F.lit(1.0), x / top)).otherwise(0.0)
    return F.when(eligible, round_up(100.0 * (1 - 0.4 * disrupted - 0.3 * part(missing, missing_p95) - 0.3 * part(gap_share, gap_p95)), 1))


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Left-closed bins; below the first edge goes to the first bin, the last is open."""
    out = F.lit(0)
    for k, e in enumerate(edges[1:-1] if len(edges) > 2 else edges[1:], 1):
        out = F.when(x >= e, k).otherwise(out)
    return out


# --- angles ----------------------------------------------------------------------------------------------


def axial_deg(dx: Column, dy: Column) -> Column:
    """Direction in [0, 180)."""
    a = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    return F.when(a >= 180.0, 0.0).otherwise(a)


def mean_axial_deg(angle: Column, weight: Column | None = None) -> Column:
    """Aggregate: circular mean by angle doubling."""
    w = F.lit(1.0) if weight is None else weight
    a = F.radians(angle * 2)
    return F.pmod(F.degrees(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))) / 2, F.lit(180.0))


def axial_difference(a: Column, b: Column) -> Column:
    """Signed difference in [-90, 90)."""
    return F.pmod(a - b + 90.0, F.lit(180.0)) - 90.0


def canonical_normal(angle: Column) -> Column:
    """Unit normal with y > 0, or y = 0 and x > 0."""
    x, y = -F.sin(F.radians(angle)), F.cos(F.radians(angle))
    sign = F.when((y < 0) | ((y == 0) & (x < 0)), -1.0).otherwise(1.0)
    return F.struct((x * sign).alias("x"), (y * sign).alias("y"))


def main_axis_deg(x: Column, y: Column) -> Column:
    """Aggregate: direction of the main axis of points."""
    return F.pmod(F.degrees(0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))), F.lit(180.0))


def project(x: Column, y: Column, ux: Column, uy: Column) -> Column:
    return x * ux + y * uy


def phase_distance(t: Column, pitch: Column, phase: Column) -> Column:
    """Distance of t from the nearest lattice line."""
    f = (t - phase) / pitch
    return F.abs(f - F.rint(f)) * pitch


def lattice_phase(t: Column, pitch: Column) -> Column:
    """Aggregate: circular mean phase of positions on a lattice."""
    a = t / pitch * (2 * 3.141592653589793)
    return F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))) / (2 * 3.141592653589793) * F.first(pitch)


# --- vectors ---------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def zero_shot(similarities: Column, n_positive: int, scale: float) -> Column:
    """struct(positive, margin, best) of prompt similarities, the first n_positive of them positive."""
    top = F.array_max(similarities)
    e = F.transform(similarities, lambda s: F.exp(scale * (s - top)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    positive = F.aggregate(F.slice(e, 1, n_positive), F.lit(0.0), lambda a, x: a + x)
    rest = F.slice(similarities, F.lit(n_positive + 1), F.greatest(F.size(similarities) - n_positive, F.lit(0)))
    return F.struct((positive / total).alias("positive"), (F.array_max(F.slice(similarities, 1, n_positive)) - F.array_max(rest)).alias("margin"), (F.array_position(similarities, top) - 1).cast("int").alias("best"))


# --- boxes and grid --------------------------------------------------------------------------------------


def box_intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area of the intersection of (x0, y0, x1, y1) boxes."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: Sequence[Column]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    i = box_intersection(a, b)
    u = box_area(a) + box_area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def clip_box(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Box of the intersection, null if there is none."""
    x0, y0, x1, y1 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


TILE_M = 51.2  # side of a grid cell in metres


def tile_of_point(x: Column, y: Column, x0: float, y0: float) -> Column:
    """struct(row, col): a point on a shared edge is of the east and south cell."""
    return F.struct(F.floor((F.lit(y0) - y) / TILE_M + 1e-9).cast("int").alias("row"), F.floor((x - F.lit(x0)) / TILE_M + 1e-9).cast("int").alias("col"))


def pixel_to_metres(u: Column, v: Column, x0: Column, y0: Column, gsd: Column) -> Column:
    return F.struct((x0 + u * gsd).alias("x"), (y0 - v * gsd).alias("y"))


def metres_to_pixel(x: Column, y: Column, x0: Column, y0: Column, gsd: Column) -> Column:
    return F.struct(((x - x0) / gsd).alias("u"), ((y0 - y) / gsd).alias("v"))


def tiles_of_box(minx: Column, miny: Column, maxx: Column, maxy: Column, x0: float, y0: float) -> Column:
    """Array of struct(row, col) of the cells a box overlaps."""
    rows = F.sequence(F.floor((F.lit(y0) - maxy) / TILE_M + 1e-9).cast("int"), F.ceil((F.lit(y0) - miny) / TILE_M - 1e-9).cast("int") - 1)
    cols = F.sequence(F.floor((minx - F.lit(x0)) / TILE_M + 1e-9).cast("int"), F.ceil((maxx - F.lit(x0)) / TILE_M - 1e-9).cast("int") - 1)
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col")))))


def encode_height(h: Column) -> Column:
    """Terrain colour: (h + 10000) * 10 in base 256, as an array of three."""
    v = F.floor((h + 10000.0) * 10.0 + 0.5).cast("long")
    return F.array(F.shiftright(v, 16) % 256, F.shiftright(v, 8) % 256, v % 256)


# --- rings and lines as arrays of struct(x, y) -----------------------------------------------------------


def ring_area(points: Column) -> Column:
    """Signed shoelace area of a ring; closed or not."""
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / 2)


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less those of the others."""
    areas = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return F.aggregate(areas, F.struct(F.lit(0.0).alias("a"), F.lit(0).alias("k")), lambda s, x: F.struct(F.when(s["k"] == 0, x).otherwise(s["a"] - x).alias("a"), (s["k"] + 1).alias("k")), lambda s: s["a"])


def line_length(points: Column) -> Column:
    turned = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), turned, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def point_in_ring(x: Column, y: Column, points: Column) -> Column:
    """Ray casting."""
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    hit = F.zip_with(points, turned, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.aggregate(hit, F.lit(False), lambda s, h: s != F.coalesce(h, F.lit(False)))


def drop_repeated_points(points: Column) -> Column:
    """Points without those equal to the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def round_points(points: Column, decimals: int) -> Column:
    """Coordinates rounded, negative zero as zero."""
    r = lambda v: F.bround(v, decimals) + F.lit(0.0)
    return F.transform(points, lambda p: F.struct(r(p["x"]).alias("x"), r(p["y"]).alias("y")))
