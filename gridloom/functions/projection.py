"""Albers equal-area projection (EPSG:5070) as closed-form column expressions.

Formulas: Snyder, Map Projections - A Working Manual (USGS PP 1395), ellipsoidal Albers and the
authalic-latitude series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    """Conic equal-area projection of an ellipsoid; angles in degrees, lengths in metres."""

    semi_major: float
    ecc2: float
    parallel_1: float
    parallel_2: float
    origin_lat: float
    origin_lon: float

    @property
    def ecc(self) -> float:
        return math.sqrt(self.ecc2)

    def _m(self, degrees: float) -> float:
        s = math.sin(math.radians(degrees))
        return math.cos(math.radians(degrees)) / math.sqrt(1 - self.ecc2 * s * s)

    def _q(self, degrees: float) -> float:
        s = math.sin(math.radians(degrees))
        e = self.ecc
        log_term = math.log((1 - e * s) / (1 + e * s)) / (2 * e)
        return (1 - self.ecc2) * (s / (1 - self.ecc2 * s * s) - log_term)

    @property
    def cone(self) -> float:
        m1, m2 = self._m(self.parallel_1), self._m(self.parallel_2)
        return (m1 * m1 - m2 * m2) / (self._q(self.parallel_2) - self._q(self.parallel_1))

    @property
    def constant(self) -> float:
        return self._m(self.parallel_1) ** 2 + self.cone * self._q(self.parallel_1)

    @property
    def origin_radius(self) -> float:
        return self.semi_major * math.sqrt(self.constant - self.cone * self._q(self.origin_lat)) / self.cone

    @property
    def polar_q(self) -> float:
        return self._q(90.0)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Projected x and y of a longitude and latitude."""
        s = F.sin(F.radians(lat))
        e, e2, n = self.ecc, self.ecc2, self.cone
        q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        radius = self.semi_major * F.sqrt(self.constant - n * q) / n
        angle = n * F.radians(lon - self.origin_lon)
        return radius * F.sin(angle), self.origin_radius - radius * F.cos(angle)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude of a projected point."""
        n, e2 = self.cone, self.ecc2
        dy = self.origin_radius - y
        radius = F.sqrt(x * x + dy * dy)
        scaled = radius * n / self.semi_major
        q = (self.constant - scaled * scaled) / n
        beta = F.asin(q / self.polar_q)
        e4, e6 = e2 * e2, e2 * e2 * e2
        lat = (
            beta
            + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
            + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
            + (761 * e6 / 45360) * F.sin(6 * beta)
        )
        return self.origin_lon + F.degrees(F.atan2(x, dy)) / n, F.degrees(lat)


# GRS80 semi-major axis and flattening, and the parallels and origin of EPSG:5070.
_FLATTENING = 1 / 298.257222101
EPSG_5070 = Albers(
    semi_major=6378137.0,
    ecc2=_FLATTENING * (2 - _FLATTENING),
    parallel_1=29.5,
    parallel_2=45.5,
    origin_lat=23.0,
    origin_lon=-96.0,
)


def project(lon: Column, lat: Column, crs: Albers = EPSG_5070) -> tuple[Column, Column]:
    return crs.forward(lon, lat)


def unproject(x: Column, y: Column, crs: Albers = EPSG_5070) -> tuple[Column, Column]:
    return crs.inverse(x, y)


def snap(coordinate: Column, scale: Column | int) -> Column:
    """Index of the grid cell of ``scale`` metres that holds a projected coordinate."""
    return F.floor(coordinate / scale)
