"""Band-ratio retrieval, column mass and emission-rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, finite, guard

# Physical constants and unit conversions.
MOLAR_CH4 = 16.043
MOLAR_DRY_AIR = 28.965
GRAVITY = 9.80665
AMBIENT_COLUMN_PPB = 1800.0
PPM_M_PER_PPB = 8.0
MOLAR_VOLUME_L = 22.4
MOLAR_CH4_KG = 0.01604
UEFF_SLOPE = 0.33
UEFF_INTERCEPT = 0.45
ALT_KG_M2_PER_PPB = PPM_M_PER_PPB * 1e-6 * 1000.0 / MOLAR_VOLUME_L * MOLAR_CH4_KG


def log_band_ratio(b11, b12) -> Column:
    """ln(b11/b12); NULL unless the ratio is finite and positive."""
    ratio = finite(F.try_divide(as_col(b11), as_col(b12)))
    return F.when(ratio > 0, F.ln(ratio))


def digital_number(reflectance, offset) -> dict[str, Column]:
    """DN with its validity flags: ``dn, valid, nodata, negative, dn_or_null``."""
    scaled = finite(reflectance) * 1e4 + as_col(offset)
    nodata = scaled.isNull()
    negative = F.coalesce(scaled <= 0, F.lit(False))
    valid = ~nodata & ~negative
    return {
        "dn": F.when(valid, scaled).otherwise(F.lit(0.0)),
        "valid": valid,
        "nodata": nodata,
        "negative": negative,
        "dn_or_null": F.when(valid, scaled),
    }


def linear_enhancement(u_target, u_reference, alpha11: float, alpha12: float) -> Column:
    """ppb from the log-ratio change under a fixed absorption contrast."""
    if alpha12 <= alpha11:
        raise ValueError("the b12 coefficient must exceed the b11 coefficient")
    return (as_col(u_target) - as_col(u_reference)) / (alpha12 - alpha11)


def simplified_slope(alpha11: float, alpha12: float) -> float:
    return 1.0 / (alpha12 - alpha11)


def cubic_ppb(log_ratio, c1, c2, c3) -> Column:
    """Odd-symmetric cubic response curve."""
    x = as_col(log_ratio)
    m = F.abs(x)
    return F.signum(x) * m * (as_col(c1) + m * (as_col(c2) + m * as_col(c3)))


def column_mass(ppb, pressure_hpa=1013.0) -> Column:
    """Excess kg per square metre for a mole-fraction enhancement."""
    air = as_col(pressure_hpa) * 100.0 / GRAVITY
    return as_col(ppb) * 1e-9 * (MOLAR_CH4 / MOLAR_DRY_AIR) * air


def column_mass_alt(ppb) -> Column:
    """Second unit path, through ppm-metres and the molar volume."""
    return as_col(ppb) * ALT_KG_M2_PER_PPB


def effective_wind(u10, slope: float = UEFF_SLOPE, intercept: float = UEFF_INTERCEPT) -> Column:
    u = as_col(u10)
    return F.when(u.isNotNull(), guard(u >= 0, u * slope + intercept, "wind speed is negative"))


def plume_length(n_pixels, pixel_area) -> Column:
    return F.sqrt(as_col(n_pixels) * as_col(pixel_area))


def source_rate(mass_kg, ueff, length) -> Column:
    """kg/h."""
    return as_col(mass_kg) * as_col(ueff) * 3600.0 / as_col(length)


def flux_identity(mean_ppb, n_pixels, pixel_area, ueff, kg_per_ppb=ALT_KG_M2_PER_PPB) -> Column:
    """Rate from the mean in-mask enhancement; NULL without a pixel."""
    n = as_col(n_pixels)
    return F.when(
        n >= 1,
        as_col(ueff) * 3600.0 * as_col(kg_per_ppb) * as_col(mean_ppb) * plume_length(n, pixel_area),
    )


def gate_limit(c1, log_ratio_limit) -> Column:
    """A log-ratio noise limit expressed in ppb at one geometry."""
    slope, limit = as_col(c1), as_col(log_ratio_limit)
    return guard((slope > 0) & (limit > 0), slope * limit, "slope and limit must be positive")


def wind_speed(u, v) -> Column:
    return F.hypot(as_col(u), as_col(v))


def wind_from_direction(u, v, legacy: bool = False) -> Column:
    """Meteorological direction the wind comes from, in degrees."""
    if legacy:
        return F.pmod(270.0 - F.degrees(F.atan2(-as_col(v), -as_col(u))), F.lit(360.0))
    return F.pmod(F.degrees(F.atan2(-as_col(u), -as_col(v))), F.lit(360.0))


def wind_components(speed, direction_from) -> tuple[Column, Column]:
    rad = F.radians(as_col(direction_from))
    return -as_col(speed) * F.sin(rad), -as_col(speed) * F.cos(rad)


def downwind_unit(u, v, north_up: bool = True) -> tuple[Column, Column]:
    """(row, col) unit vector pointing downwind on a raster; NULL without wind."""
    speed = F.hypot(as_col(u), as_col(v))
    rows = -as_col(v) if north_up else as_col(v)
    return F.when(speed > 0, rows / speed), F.when(speed > 0, as_col(u) / speed)
