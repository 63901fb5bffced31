"""Transforms between longitudes and latitudes and transverse Mercator zones, as column expressions.

Krüger's series in the third flattening, to its fourth power: below a
micrometre within a zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    axis: float
    flattening: float

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def e(self) -> float:
        return (self.flattening * (2 - self.flattening)) ** 0.5

    @property
    def radius(self) -> float:
        """Of the circle as long as a meridian."""
        n = self.n
        return self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


#: The ellipsoids of WGS 84 and of ETRS89.
WGS84 = Ellipsoid(6_378_137.0, 1 / 298.257223563)
GRS80 = Ellipsoid(6_378_137.0, 1 / 298.257222101)


@dataclass(frozen=True)
class Zone:
    """A transverse Mercator system: central meridian in degrees, scale on it, and what is added to eastings and northings."""

    meridian: float
    ellipsoid: Ellipsoid = GRS80
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0


def utm(zone: int, south: bool = False, ellipsoid: Ellipsoid = WGS84) -> Zone:
    return Zone(6.0 * zone - 183, ellipsoid, north=10_000_000.0 if south else 0.0)


def zone_of(epsg: int) -> Zone:
    """The system of an EPSG number: UTM on WGS 84 (326xx, 327xx) or on ETRS89 (258xx)."""
    family, zone = divmod(epsg, 100)
    if family not in (326, 327, 258) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG {epsg} is no UTM zone on WGS 84 or ETRS89")
    return utm(zone, family == 327, GRS80 if family == 258 else WGS84)


def _forward(n: float) -> list[float]:
    return [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]


def _inverse(n: float) -> list[float]:
    return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]


def _latitude(n: float) -> list[float]:
    return [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_plane(lon: str | Column, lat: str | Column, zone: Zone) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees."""
    e, a = zone.ellipsoid.e, zone.scale * zone.ellipsoid.radius
    s, turn = F.sin(F.radians(_column(lat))), F.radians(_column(lon) - zone.meridian)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    p, q = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = q, p
    for j, c in enumerate(_forward(zone.ellipsoid.n), 1):
        x, y = x + c * F.cos(2 * j * p) * F.sinh(2 * j * q), y + c * F.sin(2 * j * p) * F.cosh(2 * j * q)
    return zone.east + a * x, zone.north + a * y


def to_degrees(east: str | Column, north: str | Column, zone: Zone) -> tuple[Column, Column]:
    """(longitude, latitude) of eastings and northings in metres."""
    a = zone.scale * zone.ellipsoid.radius
    y, x = (_column(north) - zone.north) / a, (_column(east) - zone.east) / a
    p, q = y, x
    for j, c in enumerate(_inverse(zone.ellipsoid.n), 1):
        p, q = p - c * F.sin(2 * j * y) * F.cosh(2 * j * x), q - c * F.cos(2 * j * y) * F.sinh(2 * j * x)
    conformal = F.asin(F.sin(p) / F.cosh(q))
    lat = conformal
    for j, c in enumerate(_latitude(zone.ellipsoid.n), 1):
        lat = lat + c * F.sin(2 * j * conformal)
    return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + zone.meridian, F.degrees(lat)


def box_to_degrees(box: str, zone: Zone) -> Column:
    """A box struct (x0, y0, x1, y1) in metres as one in degrees, by its first and last corners; null where they are no place on earth."""
    (lon0, lat0), (lon1, lat1) = to_degrees(F.col(f"{box}.x0"), F.col(f"{box}.y0"), zone), to_degrees(F.col(f"{box}.x1"), F.col(f"{box}.y1"), zone)
    good = (lon0 >= -180) & (lon1 <= 180) & (lat0 >= -90) & (lat1 <= 90) & (lon0 < lon1) & (lat0 < lat1)
    return F.when(good, F.struct(lon0.alias("x0"), lat0.alias("y0"), lon1.alias("x1"), lat1.alias("y1")))
