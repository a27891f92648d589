"""Geographic expressions (WGS84 degrees, kilometres)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

# Fixed value: mean Earth radius.
EARTH_RADIUS_KM = 6371.0088


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    half_dlat = (p2 - p1) / 2.0
    half_dlon = (F.radians(as_col(lon2)) - F.radians(as_col(lon1))) / 2.0
    chord = F.pow(F.sin(half_dlat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_dlon), 2)
    return F.asin(F.sqrt(chord)) * (2.0 * EARTH_RADIUS_KM)


def earth_xyz(lon, lat) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in km; free of pole and date-line special cases."""
    lam, phi = F.radians(as_col(lon)), F.radians(as_col(lat))
    return (
        F.cos(phi) * F.cos(lam) * EARTH_RADIUS_KM,
        F.cos(phi) * F.sin(lam) * EARTH_RADIUS_KM,
        F.sin(phi) * EARTH_RADIUS_KM,
    )


def grid_to_lonlat(row, col, lon0, lat0, dlon, dlat) -> tuple[Column, Column]:
    return (
        as_col(lon0) + as_col(col) * as_col(dlon),
        as_col(lat0) + as_col(row) * as_col(dlat),
    )


def lonlat_to_grid(lon, lat, lon0, lat0, dlon, dlat) -> tuple[Column, Column]:
    """(row, col) with half-even rounding."""
    row = F.bround((as_col(lat) - as_col(lat0)) / as_col(dlat)).cast("int")
    col = F.bround((as_col(lon) - as_col(lon0)) / as_col(dlon)).cast("int")
    return row, col


def km_per_degree(lat) -> tuple[Column, Column]:
    """(km per degree of longitude, km per degree of latitude)."""
    per_lat = EARTH_RADIUS_KM * F.pi() / 180.0
    return per_lat * F.cos(F.radians(as_col(lat))), per_lat


def in_bbox(lon, lat, lon_min, lat_min, lon_max, lat_max) -> Column:
    """Closed box test."""
    return as_col(lon).between(as_col(lon_min), as_col(lon_max)) & as_col(lat).between(
        as_col(lat_min), as_col(lat_max)
    )
