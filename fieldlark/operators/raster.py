"""Array kernels of image tiles: masks, components, contours, profiles.

A tile is one row (bytes with height, width and bands); kernels run tile by
tile in ``mapInPandas``, so memory holds one tile at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur, edges repeated."""
    if sigma <= 0:
        return image.astype(float)
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = image.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        p = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(p, np.arange(i, i + image.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def vegetation_mask(rgb: np.ndarray, valid: np.ndarray, *, sigma: float, threshold: float) -> np.ndarray:
    """Blurred excess green, (2g - r - b) / (r + g + b), over a threshold in valid pixels."""
    f = rgb.astype(float)
    total = f.sum(2)
    index = np.where(total > 0, (2 * f[..., 1] - f[..., 0] - f[..., 2]) / np.where(total > 0, total, 1), 0.0)
    return (gaussian_blur(index, sigma) > threshold) & valid


def label_components(mask: np.ndarray, connectivity: int = 4) -> tuple[np.ndarray, int]:
    """Numbers 1..n in scan order of each component's first pixel; 0 outside."""
    h, w = mask.shape
    parent = np.arange(h * w)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = np.arange(h * w).reshape(h, w)
    shifts = [((slice(None), slice(1, None)), (slice(None), slice(None, -1))), ((slice(1, None), slice(None)), (slice(None, -1), slice(None)))]
    if connectivity == 8:
        shifts += [((slice(1, None), slice(1, None)), (slice(None, -1), slice(None, -1))), ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))]
    for here, there in shifts:
        both = mask[here] & mask[there]
        for a, b in zip(at[here][both].tolist(), at[there][both].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    out = np.zeros(h * w, np.int64)
    flat = np.flatnonzero(mask.ravel())
    roots = np.array([root(i) for i in flat.tolist()], np.int64)
    names, number = np.unique(roots, return_inverse=True)
    out[flat] = number + 1
    return out.reshape(h, w), len(names)


def valid_mask(rgb: np.ndarray, *, most: int, least_pixels: int) -> np.ndarray:
    """False where near-black components have at least that many pixels."""
    labels, n = label_components(rgb.max(2) <= most)
    size = np.bincount(labels.ravel(), minlength=n + 1)
    size[0] = 0
    return ~(size[labels] >= least_pixels)


def label_fractions(mask: np.ndarray, labels: np.ndarray, n: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Mean of a mask per label 1..n, NaN for labels without valid pixels."""
    ok = labels > 0 if valid is None else (labels > 0) & valid
    all_, hit = np.bincount(labels[ok], minlength=n + 1)[1:], np.bincount(labels[ok & mask], minlength=n + 1)[1:]
    return np.where(all_ > 0, hit / np.maximum(all_, 1), np.nan)


def rasterize(rings: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centres are inside (even-odd over all rings), in pixel coordinates."""
    h, w = shape
    out = np.zeros(shape, bool)
    centre = np.arange(w) + 0.5
    for v in range(h):
        xs = []
        for r in rings:
            a, b = r, np.roll(r, -1, axis=0)
            c = (a[:, 1] > v + 0.5) != (b[:, 1] > v + 0.5)
            xs += list(a[c, 0] + (v + 0.5 - a[c, 1]) * (b[c, 0] - a[c, 0]) / (b[c, 1] - a[c, 1]))
        out[v] = np.searchsorted(np.sort(xs), centre, "right") % 2 == 1
    return out


def outline_rings(mask: np.ndarray) -> list[np.ndarray]:
    """Closed pixel-edge rings of a mask, inside on the left; outsides counter-clockwise in y-down, holes the other way."""
    m = np.pad(mask, 1)
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (dy, dx), start, stop in (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))):
        edge = m[1:-1, 1:-1] & ~m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
        for v, u in np.argwhere(edge).tolist():
            step.setdefault((v + start[0], u + start[1]), []).append((v + stop[0], u + stop[1]))
    rings = []
    while step:
        first = at = min(step)
        ring, came = [], None
        while True:
            options = step[at]
            if came is not None and len(options) > 1:  # at a corner that two pixels share, turn so that 4-connected parts stay apart
                d = (at[0] - came[0], at[1] - came[1])
                options.sort(key=lambda o: -(d[1] * (o[0] - at[0]) - d[0] * (o[1] - at[1])))
            nxt = options.pop(0)
            if not options:
                del step[at]
            ring.append((at[1], at[0]))
            came, at = at, nxt
            if at == first:
                break
        p = np.array(ring, float)
        turn = np.any(np.roll(p, 1, axis=0) + np.roll(p, -1, axis=0) != 2 * p, axis=1)
        rings.append(p[turn])
    return rings


def rle_rings(runs: list[int], left: int, top: int, width: int, height: int) -> list[np.ndarray]:
    """Rings of a run-length mask that begins unset."""
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)[: width * height]
    mask = np.zeros(width * height, bool)
    mask[: len(flat)] = flat
    return [r + (left, top) for r in outline_rings(mask.reshape(height, width))]


def spacing_of(profile: np.ndarray, bin_m: float, low_m: float, high_m: float) -> tuple[float, float]:
    """(spacing, signal-to-noise) of a periodic profile: the autocorrelation peak between two lags, refined by a parabola; its spectral power over the median."""
    x = profile - profile.mean()
    n = len(x)
    f = np.fft.rfft(x, 2 * n)
    ac = np.fft.irfft(f * np.conj(f))[:n]
    a, b = max(1, int(low_m / bin_m)), min(n - 2, int(high_m / bin_m))
    if b <= a or ac[0] <= 0:
        return 0.0, 0.0
    k = a + int(ac[a : b + 1].argmax())
    y0, y1, y2 = ac[k - 1 : k + 2]
    shift = 0.5 * (y0 - y2) / (y0 - 2 * y1 + y2) if y0 - 2 * y1 + y2 else 0.0
    lag = k + float(np.clip(shift, -0.5, 0.5))
    power = np.abs(np.fft.rfft(x)) ** 2
    at = int(round(n / lag))
    peak = power[max(1, at - 1) : at + 2].max()
    return lag * bin_m, float(peak / max(np.median(power[1:]), 1e-12))


def dominant_angle(points: np.ndarray, *, coarse: float = 2.0, fine: float = 0.1, bin_px: float = 2.0) -> float:
    """Axial angle whose offset histogram varies most, by a coarse and a fine grid."""

    def best(angles: np.ndarray) -> float:
        score = []
        for a in angles:
            t = points @ np.array([-np.sin(np.radians(a)), np.cos(np.radians(a))])
            score.append(np.bincount(np.floor((t - t.min()) / bin_px).astype(int)).var())
        return float(angles[int(np.argmax(score))])

    a = best(np.arange(0, 180, coarse))
    return best(np.arange(a - coarse, a + coarse + fine / 2, fine)) % 180


def huber_line(x: np.ndarray, y: np.ndarray, delta: float, rounds: int = 25) -> tuple[float, float]:
    """(slope, intercept) by reweighted least squares."""
    w = np.ones(len(x))
    a = b = 0.0
    for _ in range(rounds):
        mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        d = (w * (x - mx) ** 2).sum()
        a2 = (w * (x - mx) * (y - my)).sum() / d if d else 0.0
        b2 = my - a2 * mx
        r = np.abs(y - a2 * x - b2)
        w = np.where(r <= delta, 1.0, delta / np.maximum(r, 1e-12))
        if abs(a2 - a) + abs(b2 - b) < 1e-12:
            break
        a, b = a2, b2
    return float(a2), float(b2)


def fuse_masks(veg: np.ndarray, prob: np.ndarray | None, corridor: np.ndarray | None, variant: str, threshold: float = 0.5) -> np.ndarray:
    """A: colour; B: colour in corridors; C: model; D: model in corridors; E: either in corridors."""
    near = np.ones_like(veg) if corridor is None else corridor
    model = np.zeros_like(veg) if prob is None else prob >= threshold
    return {"A": veg, "B": veg & near, "C": model, "D": model & near, "E": (veg | model) & near}[variant]


def map_tiles(tiles: DataFrame, kernel: Callable[[str, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``kernel(tile_id, image)`` for every tile; tiles: (tile_id, height, width, bands, data)."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for t in g.itertuples(index=False):
                rows = kernel(t.tile_id, np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, t.bands))
                yield pd.DataFrame(rows, columns=names)

    return tiles.select("tile_id", "height", "width", "bands", "data").mapInPandas(run, schema)
