"""Pixel screening expressions: quality gates, robust scores, reflectance scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, finite

# Fixed values.
MODIFIED_Z_SCALE = 0.6745
MAD_FLOOR_PPB = 2.0
REFLECTANCE_P99_MAX = 1.5
DN_P99_MIN = 20.0


def qa_pass(qa, value=None, cloud=None, *, min_qa=0.5, max_cloud=0.3, extra=()) -> Column:
    """True where every supplied quality gate holds; missing inputs fail."""
    ok = F.coalesce(finite(qa) >= min_qa, F.lit(False))
    if value is not None:
        ok = ok & finite(value).isNotNull()
    if cloud is not None:
        ok = ok & F.coalesce(finite(cloud) <= max_cloud, F.lit(False))
    for mask in extra:
        ok = ok & F.coalesce(as_col(mask), F.lit(False))
    return ok


def modified_z(value, median, mad, floor: float = MAD_FLOOR_PPB) -> Column:
    """Modified z-score; NULL (not clamped) when the spread is below ``floor``."""
    spread = finite(mad)
    return F.when(
        spread >= floor, (finite(value) - finite(median)) * MODIFIED_Z_SCALE / spread
    )


def exceeds(z, threshold: float) -> Column:
    return F.coalesce(finite(z) >= threshold, F.lit(False))


def scale_name(p99) -> Column:
    """Which reflectance convention a band's 99th percentile points to."""
    p = as_col(p99)
    return (
        F.when(p <= REFLECTANCE_P99_MAX, "reflectance")
        .when(p >= DN_P99_MIN, "dn")
        .otherwise("indeterminate")
    )


def over(score, threshold: float) -> Column:
    """Strict threshold on a continuous prediction."""
    return F.coalesce(finite(score) > threshold, F.lit(False))
