"""Distances, projection and simple geometry on columns.

Points are columns of degrees (lon, lat) or metres (x, y); lines and rings are arrays of struct<x, y>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: The GRS80 ellipsoid and the parameters of the European equal-area projection.
A, E2 = 6378137.0, 0.00669438002290
LAT0, LON0, FALSE_EASTING, FALSE_NORTHING = 52.0, 10.0, 4_321_000.0, 3_210_000.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _q(sine):
    e = math.sqrt(E2)
    log = math.log if isinstance(sine, float) else F.log
    return (1 - E2) * (sine / (1 - E2 * sine * sine) - log((1 - e * sine) / (1 + e * sine)) / (2 * e))


_SIN0 = math.sin(math.radians(LAT0))
_QP = _q(1.0)
_B0 = math.asin(_q(_SIN0) / _QP)
_RQ = A * math.sqrt(_QP / 2)
_D = A * math.cos(math.radians(LAT0)) / math.sqrt(1 - E2 * _SIN0**2) / (_RQ * math.cos(_B0))


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y in metres of the equal-area projection."""
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _q(F.sin(F.radians(lat))) / _QP)))
    turn = F.radians(lon - LON0)
    b = _RQ * F.sqrt(2 / (1 + math.sin(_B0) * F.sin(beta) + math.cos(_B0) * F.cos(beta) * F.cos(turn)))
    x = FALSE_EASTING + b * _D * F.cos(beta) * F.sin(turn)
    y = FALSE_NORTHING + b / _D * (math.cos(_B0) * F.sin(beta) - math.sin(_B0) * F.cos(beta) * F.cos(turn))
    return x, y


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """lon and lat in degrees; the inverse of `project`, by a series in the eccentricity."""
    dx, dy = (x - FALSE_EASTING) / _D, (y - FALSE_NORTHING) * _D
    rho = F.sqrt(dx * dx + dy * dy)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * _RQ)))
    safe = F.greatest(rho, F.lit(1e-12))
    beta = F.asin(F.cos(c) * math.sin(_B0) + dy * F.sin(c) * math.cos(_B0) / safe)
    lon = LON0 + F.degrees(F.atan2(dx * F.sin(c), rho * math.cos(_B0) * F.cos(c) - dy * math.sin(_B0) * F.sin(c)))
    lat = beta + (E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040) * F.sin(2 * beta) + (23 * E2**2 / 360 + 251 * E2**3 / 3780) * F.sin(4 * beta) + 761 * E2**3 / 45360 * F.sin(6 * beta)
    return F.when(rho < 1e-9, F.lit(LON0)).otherwise(lon), F.when(rho < 1e-9, F.lit(LAT0)).otherwise(F.degrees(lat))


def line_of(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(F.struct(x1.alias("x"), y1.alias("y")), F.struct(x2.alias("x"), y2.alias("y")))


def line_length(points: Column) -> Column:
    """Length of a line, 0 for fewer than two points."""
    legs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: planar(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, v: s + v)


def line_valid(points: Column) -> Column:
    """Whether a line has two points or more, all of them finite."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce((F.size(points) >= 2) & F.forall(points, lambda p: ok(p["x"]) & ok(p["y"])), F.lit(False))


def rounded_line(points: Column, digits: int = 7) -> Column:
    """Rounded points, without those that equal the one before."""
    r = F.transform(points, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    return F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))


def scaled(c: Column, least: Column, most: Column) -> Column:
    """Min-max normalised value; 0 for a constant column."""
    return F.when(most == least, F.lit(0.0)).otherwise((c - least) / (most - least))
