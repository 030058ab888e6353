"""Distances on the sphere, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean earth radius in kilometres, and kilometres in a mile.
EARTH_KM = 6371.0088
KM_PER_MILE = 1.609344


def haversine_km(lat: Column, long: Column, at_lat: float, at_long: float) -> Column:
    """Kilometres to a point; null where lat or long is."""
    dlat = F.radians(lat - F.lit(float(at_lat))) / 2
    dlong = F.radians(long - F.lit(float(at_long))) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat)) * F.lit(math.cos(math.radians(at_lat))) * F.sin(dlong) * F.sin(dlong)
    # least() would skip a null.
    return F.when(a.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def micro_km(km: Column) -> Column:
    """Distances are ordered and shown to six decimals, cut off."""
    return F.floor(km * 1_000_000).cast("long")


def km_of(distance: float, unit: str) -> float:
    if unit not in ("KM", "MI"):
        raise ValueError(f"unknown unit of distance: {unit}")
    return distance * (KM_PER_MILE if unit == "MI" else 1.0)


def show(micro: Column, unit: str = "KM") -> Column:
    """12.345678KM"""
    per = 1.0 if unit == "KM" else 1 / KM_PER_MILE
    return F.concat(F.format_string("%.6f", F.floor(micro * F.lit(per)) / 1_000_000), F.lit(unit))


def box(lat: Column, long: Column, at_lat: float, at_long: float, km: float) -> Column:
    """A necessary condition for being within km: simple bounds that reach the file scan. Near the poles and across
    the antimeridian only the latitude bounds hold."""
    dlat = math.degrees(km / EARTH_KM) * 1.000001 + 1e-9
    south, north = at_lat - dlat, at_lat + dlat
    out = lat.between(south, north)
    if south > -90 and north < 90:
        dlong = math.degrees(math.asin(min(1.0, math.sin(min(km / EARTH_KM, math.pi / 2)) / math.cos(math.radians(at_lat))))) * 1.000001 + 1e-9
        if at_long - dlong >= -180 and at_long + dlong <= 180:
            out = out & long.between(at_long - dlong, at_long + dlong)
    return out
