"""Transverse Mercator to longitude and latitude and back, by Krueger's series (sub-millimetre inside a zone)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84 and the UTM grid.
_A, _FLAT, _K0, _EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_E = np.sqrt(_FLAT * (2 - _FLAT))


def to_grid(lon: np.ndarray, lat: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """(east, north) in metres, northern hemisphere."""
    lam, phi = np.radians(np.asarray(lon, float) - (6 * zone - 183)), np.radians(np.asarray(lat, float))
    t = np.sinh(np.arctanh(np.sin(phi)) - _E * np.arctanh(_E * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.hypot(1, t))
    x, y = eta.copy(), xi.copy()
    for k, a in enumerate(_ALPHA, 1):
        x += a * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
        y += a * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
    return _EAST + _K0 * _RADIUS * x, _K0 * _RADIUS * y


def to_degrees(east: np.ndarray, north: np.ndarray, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat), the inverse of to_grid."""
    xi, eta = np.asarray(north, float) / (_K0 * _RADIUS), (np.asarray(east, float) - _EAST) / (_K0 * _RADIUS)
    x, y = eta.copy(), xi.copy()
    for k, b in enumerate(_BETA, 1):
        x -= b * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
        y -= b * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
    t = np.sin(y) / np.hypot(np.sinh(x), np.cos(y))
    lam = np.arctan2(np.sinh(x), np.cos(y))
    phi = np.arctan(t)
    for _ in range(6):  # conformal to geographic latitude
        s = np.sinh(_E * np.arctanh(_E * np.sin(phi)))
        phi = np.arctan(t * np.hypot(1, s) + s * np.hypot(1, t)) if np.ndim(t) == 0 else np.arctan(t * np.sqrt(1 + s * s) + s * np.sqrt(1 + t * t))
    return np.degrees(lam) + 6 * zone - 183, np.degrees(phi)


def degrees_of(east: Column | str, north: Column | str, zone: int) -> Column:
    """struct(lon, lat) of grid columns."""

    @F.pandas_udf("lon double, lat double")
    def run(e: pd.Series, n: pd.Series) -> pd.DataFrame:
        lon, lat = to_degrees(e.to_numpy(float), n.to_numpy(float), zone)
        return pd.DataFrame({"lon": lon, "lat": lat})

    return run(east, north)
