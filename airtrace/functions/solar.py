"""Sun position and nominal overpass time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, clamp

# Fixed value: mean local solar time of the descending node, hours.
OVERPASS_LOCAL_HOUR = 10.5


# Low-precision public almanac of the sun (degrees and days from 2000-01-01 12:00 UTC).
EPOCH_2000_DAYS = 10957.5
MEAN_LONGITUDE, MEAN_LONGITUDE_RATE = 280.460, 0.9856474
MEAN_ANOMALY, MEAN_ANOMALY_RATE = 357.528, 0.9856003
CENTRE_1, CENTRE_2 = 1.915, 0.020
OBLIQUITY, OBLIQUITY_RATE = 23.439, -0.0000004
SIDEREAL_HOURS, SIDEREAL_HOURS_RATE = 18.697374558, 24.06570982441908


def solar_zenith_deg(epoch_seconds, lat, lon) -> Column:
    """Solar zenith angle for a UTC instant given in seconds since 1970.

    The angle between the place's vertical and the unit vector to the sun: the
    ecliptic longitude gives the vector in equatorial axes, the sidereal angle
    turns the vertical into them, and their product is the cosine.
    """
    t = as_col(epoch_seconds) / 86400.0 - EPOCH_2000_DAYS
    m = F.radians(MEAN_ANOMALY + t * MEAN_ANOMALY_RATE)
    longitude = F.radians(MEAN_LONGITUDE + t * MEAN_LONGITUDE_RATE + CENTRE_1 * F.sin(m) + CENTRE_2 * F.sin(m * 2.0))
    axis = F.radians(OBLIQUITY + t * OBLIQUITY_RATE)
    sun_x, sun_y, sun_z = F.cos(longitude), F.cos(axis) * F.sin(longitude), F.sin(axis) * F.sin(longitude)
    turn = F.radians((SIDEREAL_HOURS + t * SIDEREAL_HOURS_RATE) * 15.0 + as_col(lon))
    phi = F.radians(as_col(lat))
    upward = F.cos(phi) * (F.cos(turn) * sun_x + F.sin(turn) * sun_y) + F.sin(phi) * sun_z
    return F.degrees(F.acos(clamp(upward, -1.0, 1.0)))


def nominal_overpass_seconds(day, lon) -> Column:
    """Epoch seconds of the nominal overpass on a calendar day."""
    return F.unix_date(as_col(day)) * 86400.0 + (OVERPASS_LOCAL_HOUR - as_col(lon) / 15.0) * 3600.0


def view_angles(props, has_metadata) -> tuple[Column, Column]:
    """(solar zenith, view zenith) from scene metadata JSON with documented fallbacks."""
    p = as_col(props)
    sun = F.get_json_object(p, "$.sza").cast("double")
    elevation = F.get_json_object(p, "$.sun_elevation").cast("double")
    view = F.get_json_object(p, "$.vza").cast("double")
    sza = F.coalesce(sun, 90.0 - elevation, F.lit(35.0))
    vza = F.when(as_col(has_metadata), F.coalesce(view, F.lit(10.0))).otherwise(F.lit(5.0))
    return sza, vza
