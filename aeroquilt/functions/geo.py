"""UTM projection (transverse Mercator series on WGS84), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM.
A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)
E1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
# Meridian arc: coefficients of phi, sin 2 phi, sin 4 phi, sin 6 phi.
ARC = (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, -(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024), 15 * E2**2 / 256 + 45 * E2**3 / 1024, -35 * E2**3 / 3072)
# Footpoint latitude: coefficients of sin 2 mu .. sin 8 mu.
FOOT = (3 * E1 / 2 - 27 * E1**3 / 32, 21 * E1**2 / 16 - 55 * E1**4 / 32, 151 * E1**3 / 96, 1097 * E1**4 / 512)


def utm_zone(lat: Column, lon: Column) -> Column:
    plain = (F.floor((lon + 180) / 6) + 1).cast("int")
    svalbard = F.when((lon >= 0) & (lon < 9), 31).when((lon >= 9) & (lon < 21), 33).when((lon >= 21) & (lon < 33), 35).when((lon >= 33) & (lon < 42), 37)
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    zone = F.when((lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42), svalbard).when(norway, 32).otherwise(plain)
    return F.least(F.greatest(zone, F.lit(1)), F.lit(60))


def utm_epsg(zone: Column, north: Column) -> Column:
    return F.when(north, 32600).otherwise(32700) + zone


def central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def to_utm(lat: Column, lon: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    p, w = F.radians(lat), F.radians(lon) - central_meridian(zone)
    s, c, t = F.sin(p), F.cos(p), F.pow(F.tan(p), 2)
    n, q, a = A / F.sqrt(1 - E2 * s * s), EP2 * c * c, c * w
    arc = A * (ARC[0] * p + ARC[1] * F.sin(2 * p) + ARC[2] * F.sin(4 * p) + ARC[3] * F.sin(6 * p))
    east = K0 * n * (a + (1 - t + q) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * q - 58 * EP2) * F.pow(a, 5) / 120) + 500000.0
    rise = F.pow(a, 2) / 2 + (5 - t + 9 * q + 4 * q * q) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * q - 330 * EP2) * F.pow(a, 6) / 720
    return east, K0 * (arc + n * F.tan(p) * rise) + F.when(north, 0.0).otherwise(10000000.0)


def from_utm(east: Column, northing: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees."""
    mu = (northing - F.when(north, 0.0).otherwise(10000000.0)) / (K0 * A * ARC[0])
    p = mu
    for i, c in enumerate(FOOT):
        p = p + c * F.sin(2 * (i + 1) * mu)
    s, c, t = F.sin(p), F.cos(p), F.pow(F.tan(p), 2)
    bend, q = 1 - E2 * s * s, EP2 * c * c
    n, r = A / F.sqrt(bend), A * (1 - E2) / F.pow(bend, 1.5)
    d = (east - 500000.0) / (n * K0)
    drop = F.pow(d, 2) / 2 - (5 + 3 * t + 10 * q - 4 * q * q - 9 * EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * q + 45 * t * t - 252 * EP2 - 3 * q * q) * F.pow(d, 6) / 720
    turn = d - (1 + 2 * t + q) * F.pow(d, 3) / 6 + (5 - 2 * q + 28 * t - 3 * q * q + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120
    return F.degrees(p - n * F.tan(p) / r * drop), F.degrees(central_meridian(zone) + turn / c)


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Signed degrees; S and W are negative."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)
