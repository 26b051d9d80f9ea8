"""Coordinate systems in closed form: spherical Mercator, and UTM by Krueger's series."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / RADIUS)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) of degrees."""
    n = FLATTENING / (2 - FLATTENING)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    k = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, north = eta, xi
    for j, c in enumerate(alpha, 1):
        e = e + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * a * e, 0.9996 * a * north
