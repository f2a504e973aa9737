"""Map projections in closed form, as column expressions: UTM (Krueger series), web Mercator and the European equal-area grid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The GRS80/WGS84 ellipsoid and UTM's scale and false easting.
A, FLAT, K0, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0

_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the Krueger series to the third power of the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(longitude: float, latitude: float = 0.0) -> int:
    """The zone of a place, as an EPSG number: 326xx north, 327xx south."""
    return (32600 if latitude >= 0 else 32700) + int(min(60, max(1, math.floor((longitude + 180) / 6) + 1)))


def _meridian(epsg: int) -> tuple[float, float]:
    zone, north = epsg % 100, not 32700 < epsg < 32761
    return math.radians(zone * 6 - 183), 0.0 if north else 1e7


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """``(x, y)`` in metres of degrees, in the zone of ``epsg`` (326xx, 327xx or the ETRS89 258xx)."""
    middle, south = _meridian(epsg)
    phi, lam = F.radians(lat), F.radians(lon) - middle
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + K0 * _RADIUS * x, south + K0 * _RADIUS * y


def from_utm(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """``(lon, lat)`` in degrees of metres."""
    middle, south = _meridian(epsg)
    xi, eta = (y - south) / (K0 * _RADIUS), (x - EAST) / (K0 * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(middle + F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 of degrees."""
    return A * F.radians(lon), A * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def to_equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3035 (Lambert azimuthal equal area around 10 E, 52 N) of degrees."""
    e2 = FLAT * (2 - FLAT)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(e * s) / e)
    s0 = math.sin(math.radians(52))
    qp = (1 - e2) * (1 / (1 - e2) + math.atanh(e) / e)
    q0 = (1 - e2) * (s0 / (1 - e2 * s0 * s0) + math.atanh(e * s0) / e)
    b0, rq = math.asin(q0 / qp), A * math.sqrt(qp / 2)
    d = A * math.cos(math.radians(52)) / math.sqrt(1 - e2 * s0 * s0) / (rq * math.cos(b0))
    beta, lam = F.asin(q(F.sin(F.radians(lat))) / qp), F.radians(lon) - math.radians(10)
    b = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(lam)))
    return 4321000 + b * d * F.cos(beta) * F.sin(lam), 3210000 + b / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(lam))
