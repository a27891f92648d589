"""Plume delineation: an ordered chain of mask rules with an exact per-rule ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.retrieval import AMBIENT_COLUMN_PPB, downwind_unit
from ..session import materialize
from .components import drop_small, fill_holes, pixel_components, source_component
from .stencil import binary_close, binary_open

# Rule names in their order, and documented defaults.
RULES = [
    "invalid", "amplitude", "morphology_open", "morphology_close", "morphology_fill",
    "morphology_min_size", "source_connectivity", "downwind_sector", "distance_bound", "reconnect",
]
DISABLED = "disabled by caller"
PIXEL_SIZE_M = 20.0
HALF_ANGLE_DEG = 60.0
UPWIND_TOLERANCE_M = 100.0
TRANSPORT_TIME_S = 900.0
MAX_RATIO = 2.0
MIN_COMPONENT_PX = 4
FILL_HOLE_PX = 25


def plausible(value, max_ratio: float = MAX_RATIO, minimum: float | None = 0.0) -> Column:
    """Physically possible enhancement of one pixel."""
    ok = F.col(value) <= max_ratio * AMBIENT_COLUMN_PPB
    if minimum is not None:
        ok = ok & (F.col(value) > minimum)
    return F.coalesce(ok, F.lit(False))


def in_sector(
    pixel_size: float = PIXEL_SIZE_M, half_angle: float = HALF_ANGLE_DEG, tolerance_m: float = UPWIND_TOLERANCE_M
) -> Column:
    """Inside the downwind cone of ``src_row, src_col`` under wind ``u, v``; NULL without either."""
    if not 0.0 < half_angle < 90.0:
        raise ValueError("half angle must lie between 0 and 90 degrees")
    d_row, d_col = downwind_unit("u", "v")
    y, x = (F.col("row") - F.col("src_row")) * pixel_size, (F.col("col") - F.col("src_col")) * pixel_size
    along = y * d_row + x * d_col + tolerance_m
    across = F.abs(y * d_col - x * d_row)
    return (along >= 0) & (across <= F.tan(F.radians(F.lit(half_angle))) * along)


def extent_m(max_extent: float | None = None, pixel_size: float = PIXEL_SIZE_M, seconds: float = TRANSPORT_TIME_S) -> Column:
    """Largest plume reach: given, or wind advection floored at two pixels; NULL without wind."""
    if max_extent is not None:
        return F.lit(float(max_extent))
    speed = F.hypot("u", "v")
    return F.when(speed.isNotNull(), F.greatest(speed * seconds, F.lit(2.0 * pixel_size)))


def within_extent(extent: Column, pixel_size: float = PIXEL_SIZE_M) -> Column:
    return F.hypot(F.col("row") - F.col("src_row"), F.col("col") - F.col("src_col")) * pixel_size <= extent


def delineate_plume(
    pixels: DataFrame,
    scenes: DataFrame,
    key: list[str],
    *,
    pixel_size: float = PIXEL_SIZE_M,
    max_ratio: float = MAX_RATIO,
    min_ppb: float | None = 0.0,
    open_radius: int = 1,
    close_radius: int = 1,
    fill_max: int = FILL_HOLE_PX,
    min_component: int = MIN_COMPONENT_PX,
    eight: bool = True,
    half_angle: float = HALF_ANGLE_DEG,
    tolerance_m: float = UPWIND_TOLERANCE_M,
    max_extent: float | None = None,
    disabled: frozenset[str] = frozenset(),
) -> tuple[DataFrame, DataFrame]:
    """(kept pixels, ledger).

    ``pixels``: key, ``row, col, value, in_mask`` and optionally ``valid``.
    ``scenes``: one row per scene with ``src_row, src_col, u, v`` (NULL where
    unknown; rules lacking inputs are skipped for that scene) and optionally
    the raster size ``n_rows, n_cols``. ``disabled`` switches off any of
    ``amplitude, morphology, source_connectivity, downwind_sector, distance_bound``.
    All scenes move through each rule together.
    """
    cell = [*key, "row", "col"]
    src = scenes.select(*[c for c in scenes.columns if c in {*key, "src_row", "src_col", "u", "v", "n_rows", "n_cols"}])
    located = src.where(F.col("src_row").isNotNull() & F.col("src_col").isNotNull())
    start = pixels.where("in_mask")
    # A rule that is switched off or has no field keeps its row in the ledger, without a mask of its own.
    stages: list[tuple[str, DataFrame | str]] = [("input", start.select(*cell))]
    flagged = start
    if "valid" in pixels.columns:
        flagged = flagged.where(F.coalesce("valid", F.lit(False)))
        stages.append(("invalid", flagged.select(*cell)))
    field = "value" in pixels.columns
    if "amplitude" not in disabled and field:
        flagged = flagged.where(plausible("value", max_ratio, min_ppb))
    mask = materialize(flagged.select(*cell), "amplitude")
    stages.append(("amplitude", DISABLED if "amplitude" in disabled else mask if field else "no enhancement field supplied"))

    if "morphology" in disabled:
        stages += [(r, DISABLED) for r in RULES if r.startswith("morphology")]
    else:
        if open_radius > 0:
            mask = materialize(binary_open(mask, key, open_radius, eight), "open")
            stages.append(("morphology_open", mask))
        if close_radius > 0:
            closed = binary_close(mask, key, close_radius, eight)
            mask = materialize(_inside(closed, src, key), "close")
            stages.append(("morphology_close", mask))
        if fill_max > 0:
            mask = materialize(fill_holes(mask, key, fill_max), "fill")
            stages.append(("morphology_fill", mask))
        if min_component > 1:
            labelled = pixel_components(mask, key, eight)
            mask = materialize(drop_small(labelled, key, min_component).select(*cell), "min-size")
            stages.append(("morphology_min_size", mask))

    offsets = None
    if "source_connectivity" in disabled:
        stages.append(("source_connectivity", DISABLED))
    else:
        mask, offsets = _keep_source(mask, located, key, eight, pixel_size)
        stages.append(("source_connectivity", mask))
    joined = mask.join(src, key, "left")
    if "downwind_sector" in disabled:
        stages.append(("downwind_sector", DISABLED))
    else:
        joined = joined.where(F.coalesce(in_sector(pixel_size, half_angle, tolerance_m), F.lit(True)))
        stages.append(("downwind_sector", joined.select(*cell)))
    if "distance_bound" in disabled:
        stages.append(("distance_bound", DISABLED))
    else:
        reach = extent_m(max_extent, pixel_size)
        joined = joined.where(F.coalesce(within_extent(reach, pixel_size), F.lit(True)))
        stages.append(("distance_bound", joined.select(*cell)))
    mask = joined.select(*cell)
    geometric = {"downwind_sector", "distance_bound"} - disabled
    if "source_connectivity" not in disabled and geometric:
        mask, _ = _keep_source(materialize(mask, "clipped"), located, key, eight, pixel_size)
        stages.append(("reconnect", mask))

    ledger = _ledger(stages, pixels.select(*key).distinct(), src, key, max_extent, disabled, offsets)
    return mask, materialize(ledger, "ledger")


def _inside(mask: DataFrame, src: DataFrame, key: list[str]) -> DataFrame:
    """Cut a closing back to the raster, when its size is known."""
    inside = (F.col("row") >= 0) & (F.col("col") >= 0)
    if {"n_rows", "n_cols"} <= set(src.columns):
        joined = mask.join(src.select(*key, "n_rows", "n_cols"), key, "left")
        low = F.coalesce(F.col("row") < F.col("n_rows"), F.lit(True)) & F.coalesce(F.col("col") < F.col("n_cols"), F.lit(True))
        return joined.where(inside & low).select(*key, "row", "col")
    return mask.where(inside)


def _keep_source(mask, located, key, eight, pixel_size):
    """Source components where a source is known; other scenes stay as they are."""
    has = located.select(*key)
    kept, chosen = source_component(mask.join(has, key, "left_semi"), located, key, eight, pixel_size)
    rest = mask.join(has, key, "left_anti")
    cell = [*key, "row", "col"]
    return materialize(kept.select(*cell).unionByName(rest.select(*cell)), "source"), chosen


def _ledger(stages, all_scenes, src, key, max_extent, disabled, offsets) -> DataFrame:
    """Net pixel change per rule; the running total always balances."""
    tagged = reduce(
        DataFrame.unionByName,
        [m.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("_of", F.lit(i)) for i, (_, m) in enumerate(stages) if not isinstance(m, str)],
    )
    steps, of = [], 0
    for i, (n, m) in enumerate(stages):
        of = of if isinstance(m, str) else i
        steps.append(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("rule"), F.lit(of).alias("_of"), F.lit(m if isinstance(m, str) else None).cast("string").alias("_off")))
    frame = all_scenes.withColumn("_step", F.explode(F.array(*steps))).select(*key, "_step.*")
    counts = frame.join(tagged, [*key, "_of"], "left").select(*key, "ord", "rule", "_off", F.coalesce("n", F.lit(0)).alias("n_after"))
    w = Window.partitionBy(*key).orderBy("ord")
    moved = counts.withColumn("n_before", F.lag("n_after").over(w)).join(src, key, "left")
    no_source = F.col("src_row").isNull() | F.col("src_col").isNull()
    calm = F.coalesce(F.hypot("u", "v") <= 0, F.lit(True))
    no_reach = F.lit(False) if max_extent is not None else F.col("u").isNull() | F.col("v").isNull()
    empty = F.col("n_before") == 0
    sector, bound = no_source | calm, no_source | no_reach
    note = (
        F.when(F.col("_off").isNotNull(), F.col("_off"))
        .when((F.col("rule") == "source_connectivity") & no_source, "no source position supplied")
        .when((F.col("rule") == "source_connectivity") & empty, "mask already empty")
        .when((F.col("rule") == "downwind_sector") & sector, "needs both a source position and a wind vector")
        .when((F.col("rule") == "distance_bound") & bound, "needs a source position and either max_extent_m or a wind speed")
        .when((F.col("rule") == "reconnect") & empty, "mask empty after geometric clipping")
    )
    # Without a geometric clip there is nothing to reconnect.
    unclipped = reduce(Column.__and__, [F.lit(True), *(c for r, c in (("downwind_sector", sector), ("distance_bound", bound)) if r not in disabled)])
    out = moved.where((F.col("rule") != "input") & ~((F.col("rule") == "reconnect") & unclipped)).select(
        *key, "ord", "rule", F.when(note.isNull(), "applied").otherwise("skipped").alias("status"), note.alias("note"),
        "n_before", "n_after",
        F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0)).alias("dropped_px"),
        F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0)).alias("added_px"),
    )
    if offsets is not None:
        far = offsets.where(F.col("offset_m") > 0).select(
            *key, F.lit("source_connectivity").alias("rule"),
            F.concat(F.lit("source pixel is not inside the candidate mask; kept the nearest component, "), F.round("offset_m").cast("long"), F.lit(" m away")).alias("_far"),
        )
        out = out.join(far, [*key, "rule"], "left").withColumn("note", F.coalesce("note", "_far")).drop("_far")
    return out


def delineation_report(
    ledger: DataFrame, key: list[str], means: DataFrame | None = None, pixel_size: float = PIXEL_SIZE_M
) -> DataFrame:
    """Scene totals, dominant rule and implied rate change from a ledger.

    ``means`` carries ``mean_before`` and ``mean_after`` per scene.
    """
    first = F.min_by("n_before", "ord")
    out = ledger.groupBy(*key).agg(
        first.alias("n_input_px"), F.max_by("n_after", "ord").alias("n_kept_px"),
        F.sum("dropped_px").alias("n_dropped_px"), F.sum("added_px").alias("n_added_px"),
        F.max_by("rule", F.when(F.col("dropped_px") > 0, F.struct("dropped_px", (-F.col("ord")).alias("o")))).alias("dominant_rule"),
    )
    if means is None:
        out = out.withColumn("mean_before", F.lit(None).cast("double")).withColumn("mean_after", F.lit(None).cast("double"))
    else:
        out = out.join(means, key, "left")
    area = F.sqrt(F.try_divide("n_kept_px", "n_input_px"))
    factor = (
        F.when(F.col("n_input_px") == 0, F.lit(None).cast("double"))
        .when(F.col("n_kept_px") == 0, F.lit(0.0))
        .when(F.col("mean_before").isNull() | F.col("mean_after").isNull() | (F.col("mean_before") == 0), area)
        .otherwise(F.col("mean_after") / F.col("mean_before") * area)
    )
    return out.select(
        "*", (F.col("n_input_px") * pixel_size**2 / 1e6).alias("area_km2_before"),
        (F.col("n_kept_px") * pixel_size**2 / 1e6).alias("area_km2_after"),
        F.try_divide("n_input_px", "n_kept_px").alias("area_shrink_factor"), factor.alias("implied_flux_factor"),
        (F.col("n_kept_px") == F.col("n_input_px") - F.col("n_dropped_px") + F.col("n_added_px")).alias("balanced"),
    )


def rule_shares(ledger: DataFrame, key: list[str]) -> DataFrame:
    """Each rule's status and share of the input mask."""
    first = ledger.groupBy(*key).agg(F.min_by("n_before", "ord").alias("n_input_px"))
    return ledger.join(first, key).select(
        *key, "rule", "status", "dropped_px", "added_px",
        F.coalesce(F.try_divide("dropped_px", "n_input_px"), F.lit(0.0)).alias("dropped_frac_of_input"),
    )
