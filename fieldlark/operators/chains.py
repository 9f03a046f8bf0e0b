"""Kernels of ordered greedy steps on rows, chains and paths, one bounded group each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.operators import geometry as Y


def longest_chains(rows: Sequence[int], start: Sequence[float], stop: Sequence[float], *, width: float, least_rows: int) -> list[list[int]]:
    """Chains of gaps in neighbouring rows that share at least ``width`` along the axis.

    The longest chain (ties: the widest common stretch, then the earliest) is
    taken out again and again until none has ``least_rows`` rows.
    """
    left, out = set(range(len(rows))), []
    while True:
        best: dict[int, tuple[int, float, float, int | None]] = {}
        for i in sorted(left, key=lambda k: (rows[k], start[k], k)):
            options = [(1, start[i], stop[i], None)]
            for j in left:
                if j in best and rows[j] == rows[i] - 1:
                    n, a, b, _ = best[j]
                    a, b = max(a, start[i]), min(b, stop[i])
                    if b - a >= width:
                        options.append((n + 1, a, b, j))
            best[i] = max(options, key=lambda o: (o[0], o[2] - o[1], -(o[3] if o[3] is not None else -1)))
        if not best:
            return out
        end = max(best, key=lambda i: (best[i][0], best[i][2] - best[i][1], -i))
        if best[end][0] < least_rows:
            return out
        chain = []
        at: int | None = end
        while at is not None:
            chain.append(at)
            at = best[at][3]
        out.append(chain[::-1])
        left -= set(chain)


def constrained_groups(n: int, pairs: Sequence[tuple[int, int, float]], kind: Sequence) -> list[list[int]]:
    """Union by rising cost (ties: indices) of groups that have no kind in common: no chain has two pieces of one tile."""
    group, kinds = list(range(n)), [{k} for k in kind]

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        x, y = root(a), root(b)
        if x != y and not kinds[x] & kinds[y]:
            x, y = min(x, y), max(x, y)
            group[y] = x
            kinds[x] |= kinds[y]
    found: dict[int, list[int]] = {}
    for i in range(n):
        found.setdefault(root(i), []).append(i)
    return [found[r] for r in sorted(found)]


def merge_angles(angles: Sequence[float], tol: float) -> list[int]:
    """Indices kept in order: an axial angle within ``tol`` of a kept one goes."""
    kept: list[int] = []
    for i, a in enumerate(angles):
        if all(abs((a - angles[k] + 90) % 180 - 90) > tol for k in kept):
            kept.append(i)
    return kept


def outside_lengths(line: np.ndarray, region: Sequence[Y.Polygon]) -> np.ndarray:
    """Length of each segment outside a set of polygons: cut at every crossing, tested at middles."""
    edges = np.array([(*p, *q) for poly in region for r in poly for p, q in zip(r, np.roll(r, -1, axis=0))], float).reshape(-1, 4)
    out = []
    for a, b in zip(line[:-1], line[1:]):
        d, e = b - a, edges[:, 2:] - edges[:, :2]
        det = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = edges[:, :2] - a
            t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / det
            s = (w[:, 0] * d[1] - w[:, 1] * d[0]) / det
        cut = np.unique(np.concatenate(([0.0, 1.0], t[(det != 0) & (t > 0) & (t < 1) & (s >= 0) & (s <= 1)])))
        middle = a + ((cut[:-1] + cut[1:]) / 2)[:, None] * d
        inside = np.any([Y.inside(middle, p) for p in region], axis=0) if len(region) else np.zeros(len(middle), bool)
        out.append(float((np.diff(cut) * ~inside).sum() * np.hypot(*d)))
    return np.array(out)


def string_pull(line: np.ndarray, anchors: set[int], region: Sequence[Y.Polygon], lookahead: int = 20) -> list[int]:
    """Indices of vertices kept: from each to the furthest within ``lookahead`` that is seen inside the region, never past an anchor."""
    keep, at = [0], 0
    while at < len(line) - 1:
        limit = min([len(line) - 1, at + lookahead, *(k for k in anchors if k > at)])
        at = next((k for k in range(limit, at, -1) if k == at + 1 or outside_lengths(line[[at, k]], region)[0] < 1e-9), at + 1)
        keep.append(at)
    return keep


def covered(line: np.ndarray, points: np.ndarray, radius: float) -> np.ndarray:
    return Y.distance_to_line(points, line) <= radius


def drop_runs(saving: Sequence[float], optional: Sequence[bool], need: float) -> list[int]:
    """Stops to drop, whole runs of neighbouring optional stops by falling saving, until ``need`` is saved."""
    runs, k = [], 0
    while k < len(saving):
        if optional[k]:
            j = k
            while j < len(saving) and optional[j]:
                j += 1
            runs.append((sum(saving[k:j]), k, j))
            k = j
        else:
            k += 1
    out, saved = [], 0.0
    for s, a, b in sorted(runs, key=lambda r: (-r[0], r[1])):
        if saved >= need:
            break
        out += range(a, b)
        saved += s
    return sorted(out)


def cross_paths(gaps: DataFrame, block: str, row: str, start: str, stop: str, *, width: float, least_rows: int) -> DataFrame:
    """(block, path, row, start, stop): longest chains of aligned gaps per block."""
    kinds = {f.name: f.dataType.simpleString() for f in gaps.schema}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        chains = longest_chains(g[row].tolist(), g[start].tolist(), g[stop].tolist(), width=width, least_rows=least_rows)
        rows = [(g[block].iloc[0], n + 1, *g[[row, start, stop]].iloc[i]) for n, c in enumerate(chains) for i in c]
        return pd.DataFrame(rows, columns=[block, "path", row, start, stop])

    return gaps.select(block, row, F.col(start).cast("double"), F.col(stop).cast("double")).groupBy(block).applyInPandas(run, f"`{block}` {kinds[block]}, path int, `{row}` {kinds[row]}, `{start}` double, `{stop}` double")


def chains_of(pieces: DataFrame, pairs: DataFrame, group: str, piece: str, tile: str) -> DataFrame:
    """(group, piece, chain): constrained union of a group's pieces. pairs: (group, a, b, cost)."""
    kind = pieces.schema[piece].dataType.simpleString()

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(piece)
        at = {v: i for i, v in enumerate(p[piece])}
        links = [(at[a], at[b], c) for a, b, c in zip(q["a"], q["b"], q["cost"]) if a in at and b in at]
        rows = [(p[group].iloc[0], p[piece].iloc[i], n) for n, c in enumerate(constrained_groups(len(p), links, p[tile].tolist())) for i in c]
        return pd.DataFrame(rows, columns=[group, piece, "chain"])

    return pieces.groupBy(group).cogroup(pairs.groupBy(group)).applyInPandas(run, f"`{group}` {pieces.schema[group].dataType.simpleString()}, `{piece}` {kind}, chain int")
