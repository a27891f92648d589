"""Scene selection over pass catalogs: targets, references, backgrounds.

Pass catalogs are metadata; selections are grouped minima or ranks inside one
event's handful of days, never sorts over the whole catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import platform, relative_orbit
from ..functions.numeric import fixed_text

MAX_NODATA = 0.02


def score_passes(
    passes: DataFrame, *, margin_days: int = 2, max_days: int = 12, max_cloud: float = 0.05,
    min_corr: float = 0.95, max_sigma: float = 3.0, w_cloud=0.5, w_corr=0.3, w_near=0.2,
) -> DataFrame:
    """Add ``rejected_reason`` and ``score`` to ``event, pass_id, dt_days, cloud, corr, mbsp``."""
    gap = F.abs("dt_days")
    reason = (
        F.when(gap < margin_days, F.lit(f"inside {margin_days}d exclusion zone"))
        .when(gap > max_days, F.lit("outside +/-window"))
        .when(F.col("cloud") > max_cloud, F.concat(F.lit("cloud "), fixed_text("cloud", 2), F.lit(f" > {max_cloud:.2f}")))
        .when(F.col("corr") < min_corr, F.concat(F.lit("surface corr "), fixed_text("corr", 3), F.lit(f" < {min_corr}")))
        .when(F.col("mbsp") > max_sigma, F.concat(F.lit("own plume "), fixed_text("mbsp", 1), F.lit("sigma")))
    )
    half = float(max(max_days - margin_days, 1))
    near = F.greatest(1.0 - gap / half, F.lit(0.0))
    score = F.round((1.0 - F.col("cloud")) * w_cloud + F.col("corr") * w_corr + near * w_near, 5)
    return passes.withColumn("rejected_reason", reason).withColumn(
        "score", F.when(F.col("rejected_reason").isNull(), score)
    )


def select_reference_pass(passes: DataFrame, ordinal: str, **rules) -> DataFrame:
    """Best surviving pass per event (first listed on ties); NULL means detection only."""
    scored = score_passes(passes, **rules)
    best = F.max_by("pass_id", F.when(F.col("score").isNotNull(), F.struct("score", (-F.col(ordinal)).alias("o"))))
    return scored.groupBy("event").agg(
        best.alias("chosen"), F.max("score").alias("score"), F.count("rejected_reason").alias("n_rejected")
    )


def pick_covering(scenes: DataFrame, key: list[str], ordinal: str, max_nodata: float = MAX_NODATA) -> DataFrame:
    """First listed scene that covers the window, else the one with the least nodata."""
    covers = F.col("nodata") <= max_nodata
    order = F.struct(
        (~covers).alias("late"), F.when(covers, F.lit(0.0)).otherwise(F.col("nodata")).alias("n"), F.col(ordinal).alias("o")
    )
    g = scenes.groupBy(*key).agg(F.min_by(F.struct("scene", "nodata"), order).alias("s"), F.max(covers).alias("covered"))
    return g.select(*key, "s.scene", "s.nodata", "covered")


def target_scene_pick(scenes: DataFrame, ordinal: str, first: int = -16, last: int = 8) -> DataFrame:
    """Covering scene on the day nearest each event, the earlier day on ties."""
    # The first covering scene of the nearest day that has one: a single minimum, combined before the shuffle.
    order = F.struct(F.abs("dt_days").alias("a"), F.col("dt_days").alias("d"), F.col(ordinal).alias("o"))
    covering = scenes.where(F.col("dt_days").between(first, last) & (F.col("nodata") <= MAX_NODATA))
    return covering.groupBy("event").agg(F.min_by(F.struct("dt_days", "scene", "nodata"), order).alias("t")).select(
        "event", "t.dt_days", "t.scene", "t.nodata"
    )


def pair_references(
    targets: DataFrame, scenes: DataFrame, ordinal: str, want: int = 3, min_lag: int = 3, max_lag: int = 21
) -> DataFrame:
    """Comparison scenes before each target: same platform, same orbit first, one scene per day.

    Returns ``event, dt_days, scene, nodata, same_orbit, rank`` (newest first). ``targets`` has a row per event. The passes are read
    once; beyond the first scenes of the days, a window holds two rows per day of the lags. Event and
    platform are the key of the join, the minima and the windows, so they share one shuffle.
    """
    t = targets.select(
        "event", F.col("dt_days").alias("t_day"), platform("scene").alias("_plat"), relative_orbit("scene").alias("t_orbit")
    )
    lag = F.col("t_day") - F.col("dt_days")
    pool = (
        scenes.where(F.col("nodata") <= MAX_NODATA).withColumn("_plat", platform("scene")).join(t, ["event", "_plat"])
        .where(lag.between(min_lag, max_lag)).withColumn("same_orbit", relative_orbit("scene") == F.col("t_orbit"))
    )
    first = F.min_by(F.struct("scene", "nodata"), ordinal).alias("s")
    daily = pool.groupBy("event", "_plat", "same_orbit", "dt_days").agg(first)
    of = ["event", "_plat"]
    newest = Window.partitionBy(*of, "same_orbit").orderBy(F.col("dt_days").desc())
    own = daily.withColumn("_own", F.col("same_orbit") & (F.row_number().over(newest) <= want))
    own = own.withColumn("_taken", F.max("_own").over(Window.partitionBy(*of, "dt_days"))).withColumn("_have", F.count_if("_own").over(Window.partitionBy(*of)))
    fill = own.where("_own or not same_orbit and not _taken").withColumn("_r", F.row_number().over(newest))
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.col("dt_days").desc()))
    return fill.where(F.col("_own") | (F.col("_r") <= want - F.col("_have"))).select(
        "event", "dt_days", "s.scene", "s.nodata", "same_orbit", rank.alias("rank")
    )


def background_lag_search(
    targets: DataFrame, scenes: DataFrame, ordinal: str, max_cloud: float = 0.05,
    excluded: tuple[int, int] | None = None, step: int = 10, reach: int = 70,
) -> DataFrame:
    """Nearest acceptable background at whole multiples of the repeat cycle on either side.

    Lags are tried as +step, -step, +2*step, ...; the first clear one wins,
    else the least cloudy. ``excluded`` is a closed day range (relative to the event).
    """
    t = targets.select("event", F.col("dt_days").alias("t_day"), platform("scene").alias("t_plat"))
    lag = F.col("t_day") - F.col("dt_days")
    pool = scenes.join(t, "event").where(
        (lag != 0) & (F.abs(lag) <= reach) & (F.abs(lag) % step == 0) & (platform("scene") == F.col("t_plat"))
    )
    if excluded is not None:
        pool = pool.where(~F.col("dt_days").between(*excluded))
    daily = pick_covering(pool, ["event", "t_day", "dt_days"], ordinal).where("covered")
    daily = daily.join(scenes.select("event", "scene", "cloud"), ["event", "scene"])
    turn = F.abs(lag) * 2 - (lag > 0).cast("int")
    order = F.struct(
        (F.col("cloud") > max_cloud).alias("late"),
        F.when(F.col("cloud") <= max_cloud, F.lit(0.0)).otherwise(F.col("cloud")).alias("c"), turn.alias("o"),
    )
    return daily.groupBy("event").agg(
        F.min_by(F.struct("scene", lag.alias("lag_days"), "cloud"), order).alias("b")
    ).select("event", "b.scene", "b.lag_days", "b.cloud", (F.col("b.cloud") > max_cloud).alias("reference_limited"))


def pick_pair(
    scenes: DataFrame, ordinal: str, target_range=(-1, 4), lag_range: tuple[int, int | None] = (4, 16)
) -> DataFrame:
    """Simple pairing: target nearest the event, reference nearest before the target."""
    t = scenes.where(F.col("dt_days").between(*target_range)).groupBy("event").agg(
        F.min_by(F.struct("scene", "dt_days"), F.struct(F.abs("dt_days").alias("a"), "dt_days", ordinal)).alias("t")
    )
    lag = F.col("t.dt_days") - F.col("dt_days")
    ok = lag >= lag_range[0] if lag_range[1] is None else lag.between(*lag_range)
    return (
        scenes.join(t, "event").where(ok)
        .groupBy("event", "t")
        .agg(F.min_by(F.struct("scene", lag.alias("lag")), F.struct(lag, ordinal)).alias("r"))
        .select("event", F.col("t.scene").alias("target"), F.col("r.scene").alias("reference"), F.col("r.lag").alias("lag_days"))
    )


def window_coverage(pixels: DataFrame, key: list[str], expected: Column, value: str = "value") -> DataFrame:
    """Share of the expected window that holds no finite pixel."""
    return pixels.groupBy(*key).agg(F.count(value).alias("n_finite")).withColumn(
        "nodata_fraction", 1.0 - F.col("n_finite") / expected
    )


def cloud_fraction(pixels: DataFrame, key: list[str], classes: str = "cloud_class") -> DataFrame:
    """Share of pixels in the cloud and shadow classes 1, 2 and 3."""
    bad = F.col(classes).isin(1, 2, 3)
    return pixels.groupBy(*key).agg(
        F.avg(bad.cast("double")).alias("cloud_fraction"), F.count_if(~bad).alias("n_clear")
    )


def reference_pass_stats(bands: DataFrame, key: list[str], noise: DataFrame) -> DataFrame:
    """Correlation of each pass with the per-pixel median, and its strongest anomaly in noise units.

    ``bands``: key, ``pass_id, row, col, b12, u``; ``noise``: key, ``pass_id, sigma``.
    """
    pixel = [*key, "row", "col"]
    med = bands.groupBy(*pixel).agg(
        F.percentile("b12", F.lit(0.5)).alias("_m12"), F.percentile("u", F.lit(0.5)).alias("_mu")
    )
    joined = bands.join(med, pixel)
    stats = joined.groupBy(*key, "pass_id").agg(
        F.corr("b12", "_m12").alias("surface_corr"), F.max(F.abs(F.col("u") - F.col("_mu"))).alias("_peak")
    )
    return stats.join(noise, [*key, "pass_id"]).select(
        *key, "pass_id", "surface_corr", F.try_divide("_peak", "sigma").alias("mbsp_abs_sigma")
    )
