"""Votes, peaks, fits and periods against numpy one tile at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.operators import row_votes as V
from fieldlark.operators.raster import dominant_angle, huber_line


def field(seed, angle, spacing=14.0, rows=9, n=120):
    r = np.random.default_rng(seed)
    t = r.uniform(-120, 120, rows * n)
    o = np.repeat((np.arange(rows) - rows // 2) * spacing, n) + r.normal(0, 0.8, rows * n)
    o[::37] += r.uniform(-5, 5, len(o[::37]))
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return np.column_stack((t * c - o * s, t * s + o * c))


@pytest.fixture(scope="module")
def tiles():
    return {"a": field(1, 31.3), "b": field(2, 118.0, 20.0, 6), "c": field(3, 0.4)}


@pytest.fixture(scope="module")
def points(spark, tiles):
    rows = [(k, float(x), float(y)) for k, p in tiles.items() for x, y in p] + [("a", None, 1.0)]
    return spark.createDataFrame(rows, "tile string, x double, y double").repartition(4)


def test_angles(points, tiles):
    got = {r.tile: r.angle for r in V.dominant_angles(points, "tile", bin_size=2.0).collect()}
    for k, p in tiles.items():
        want = dominant_angle(p)
        assert min(abs(got[k] - want), 180 - abs(got[k] - want)) < 0.75
    truth = {"a": 31.3, "b": 118.0, "c": 0.4}
    assert all(min(abs(got[k] - v), 180 - abs(got[k] - v)) < 0.6 for k, v in truth.items())


def test_rows(points, tiles):
    rows = V.detect_rows(points, "tile", bin_size=2.0, apart=3, least=25, reach=4.0, delta=1.0, gate=2.0, rounds=6).collect()
    for k, (angle, spacing, n) in {"a": (31.3, 14.0, 9), "b": (118.0, 20.0, 6), "c": (0.4, 14.0, 9)}.items():
        mine = [r for r in rows if r.tile == k]
        assert len(mine) == n and not any(r.refused for r in mine)
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        offsets = sorted((r.y0 + r.y1) / 2 * c - (r.x0 + r.x1) / 2 * s for r in mine)
        assert np.allclose(offsets, (np.arange(n) - n // 2) * spacing, atol=0.6)
        assert all(min(abs(r.angle - angle), 180 - abs(r.angle - angle)) < 0.6 and math.hypot(r.x1 - r.x0, r.y1 - r.y0) > 200 for r in mine)


def test_fits_as_the_kernel(spark):
    r = np.random.default_rng(5)
    groups = {}
    for k in range(7):
        t = r.uniform(1000, 1200, 60)
        o = 0.03 * k * t - 40 + r.normal(0, 0.5, 60)
        o[::9] += 25
        groups[k] = (t, o)
    groups[7] = (np.full(5, 3.0), np.arange(5.0))
    rows = [(k, float(a), float(b)) for k, (t, o) in groups.items() for a, b in zip(t, o)]
    got = {x.k: x for x in V.fit_lines(spark.createDataFrame(rows, "k int, t double, o double"), ["k"], delta=1.0, rounds=25).collect()}
    for k in range(7):
        slope, base = huber_line(*groups[k], 1.0)
        assert got[k].slope == pytest.approx(slope, abs=1e-5) and got[k].intercept == pytest.approx(base, abs=1e-2) and got[k].n == 60
    assert got[7].slope == 0 and got[7].intercept == pytest.approx(2.0, abs=0.5)


def test_periods(spark):
    n = np.arange(240)
    wave = lambda i, p: float(9 * math.sin(2 * math.pi * i / p) + (i * 7 % 5))
    rows = [("x", int(i), wave(i, 8)) for i in n] + [("y", int(i), wave(i, 16) + wave(i, 8) / 3) for i in n]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    periods = [3 + 0.5 * j for j in range(60)]
    power = V.periodogram(df, ["k"], "i", "v", periods)
    for k in "xy":
        v = np.array([r[2] for r in rows if r[0] == k])
        v = v - v.mean()
        want = {p: abs((v * np.exp(2j * np.pi * n / p)).sum()) ** 2 for p in periods}
        got = {r.period: r.power for r in power.where(power.k == k).collect()}
        assert all(got[p] == pytest.approx(want[p], rel=1e-6, abs=1e-3) for p in periods)
    snr = {r.k: r for r in V.spectral_snr(power, ["k"], 8.0, wide=0.05).collect()}
    assert snr["x"].snr > 20 and not snr["x"].harmonic and snr["y"].harmonic
    at = spark.createDataFrame([("x", 3.0 + 8 * i + (0.3 if i % 2 else -0.3)) for i in range(20)] + [("x", 7.1)], "k string, at double")
    phase = V.phases(at, ["k"], "at", 8.0)
    assert phase.first().phase == pytest.approx(3.0, abs=0.4)
    held = at.join(phase, "k").select("at", V.is_periodic(F.col("at"), F.col("phase"), 8.0, 0.15).alias("p")).collect()
    assert all(r.p == (r["at"] != 7.1) for r in held)
