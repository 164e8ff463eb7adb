"""Universal transverse Mercator: zones, and coordinates by the Krüger series, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid, and the grid's scale and offsets.
RADIUS, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm_zone(lon: Column) -> Column:
    """1 to 60; the far end of the last zone belongs to it."""
    return F.least(F.floor((lon + 180.0) / 6.0) + 1, F.lit(60)).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """The EPSG code of a place's zone, south of the equator below 0."""
    return (F.when(lat < 0, F.lit(32700)).otherwise(F.lit(32600)) + utm_zone(lon)).cast("int")


def utm_text(epsg: Column) -> Column:
    """A zone's parameters as projection libraries write them."""
    south = F.when(epsg >= 32700, F.lit(" +south")).otherwise(F.lit(""))
    return F.concat(F.lit("+proj=utm +zone="), (epsg % 100).cast("int").cast("string"), south, F.lit(" +datum=WGS84 +units=m +no_defs"))


# Fixed value: the parallel of true scale of the global equal-area grid, EPSG 6933.
TRUE_SCALE = 30.0


def _equal_area() -> float:
    """The factor of longitudes on that grid."""
    s = math.sin(math.radians(TRUE_SCALE))
    return math.cos(math.radians(TRUE_SCALE)) / math.sqrt(1 - FLATTENING * (2 - FLATTENING) * s * s)


def to_equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres on the global equal-area grid (EPSG 6933): areas there are areas on the ellipsoid."""
    e2 = FLATTENING * (2 - FLATTENING)
    e, k, s = math.sqrt(e2), _equal_area(), F.sin(F.radians(lat))
    q = (1.0 - e2) * (s / (1.0 - e2 * s * s) + F.atanh(e * s) / e)
    return F.lit(RADIUS * k) * F.radians(lon), F.lit(RADIUS / (2 * k)) * q


def _series() -> tuple[float, list[float], list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return a, forward, back


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, in the zone of ``epsg``, to a millimetre within it."""
    a, alpha, _ = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - (epsg % 100) * 6.0 + 183.0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        y = y + c * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    south = F.when(epsg >= 32700, F.lit(SOUTH)).otherwise(F.lit(0.0))
    return F.lit(SCALE * a) * x + EAST, F.lit(SCALE * a) * y + south


def from_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    a, _, beta = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    south = F.when(epsg >= 32700, F.lit(SOUTH)).otherwise(F.lit(0.0))
    xi, eta = (y - south) / (SCALE * a), (x - EAST) / (SCALE * a)
    p, q = xi, eta
    for j, c in enumerate(beta, 1):
        p = p - c * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        q = q - c * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    phi = chi
    for _ in range(5):  # the conformal latitude's inverse, by fixed point
        s = e * F.sin(phi)
        phi = 2.0 * F.atan(F.tan(math.pi / 4 + chi / 2.0) * F.pow((1.0 + s) / (1.0 - s), e / 2.0)) - math.pi / 2
    return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + (epsg % 100) * 6.0 - 183.0, F.degrees(phi)


def convert(x, y, own: int, to: int):
    """Arrays of coordinates from one EPSG system to another, of 4326, zones of universal transverse Mercator and, as a
    target, 6933: the formulas above in numpy, for vertices of shapes."""
    import numpy as np

    a, alpha, beta = _series()
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    if own == to:
        return x, y
    if own != 4326:
        xi, eta = (y - (SOUTH if own >= 32700 else 0.0)) / (SCALE * a), (x - EAST) / (SCALE * a)
        p, q = xi, eta
        for j, c in enumerate(beta, 1):
            p, q = p - c * np.sin(2 * j * xi) * np.cosh(2 * j * eta), q - c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        chi = np.arcsin(np.sin(p) / np.cosh(q))
        phi = chi
        for _ in range(5):
            s = e * np.sin(phi)
            phi = 2 * np.arctan(np.tan(math.pi / 4 + chi / 2) * ((1 + s) / (1 - s)) ** (e / 2)) - math.pi / 2
        x, y = np.degrees(np.arctan2(np.sinh(q), np.cos(p))) + own % 100 * 6.0 - 183.0, np.degrees(phi)
    if to == 4326:
        return x, y
    if to == 6933:
        k, s = _equal_area(), np.sin(np.radians(y))
        return RADIUS * k * np.radians(x), RADIUS / (2 * k) * (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)
    phi, lam = np.radians(y), np.radians(x - to % 100 * 6.0 + 183.0)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    u, v = eta, xi
    for j, c in enumerate(alpha, 1):
        u, v = u + c * np.cos(2 * j * xi) * np.sinh(2 * j * eta), v + c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return SCALE * a * u + EAST, SCALE * a * v + (SOUTH if to >= 32700 else 0.0)
