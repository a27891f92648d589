"""Detection limits: noise anchors, empirical floors, limit curves and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import acquisition_time, noise_key, platform
from ..functions.retrieval import cubic_ppb
from ..functions.solar import nominal_overpass_seconds, solar_zenith_deg
from .calibration import attach_curve
from .quantify import detection_limit

# Nominal geometry and documented pixel counts.
NOMINAL_SATELLITE = "S2B"
NOMINAL_VZA_DEG = 5.0
DEFAULT_U10 = 3.0
#: A field that a key does not state.
ANY = "*"
MIN_PIXELS = 25
MIN_PIXEL_SENSITIVITY = (9, 25, 100)
ASSUMED_SIGMA_PPB = {"homogeneous_arid": 12.0, "heterogeneous": 25.0}

# Texts that travel with the numbers.
COMMUNITY_LABEL = (
    "COMMUNITY DETECTION FLOOR %.1f-%.1f t/h — DEMONSTRATED BY PUBLISHED TEAMS "
    "(Sherwin et al. 2023/2024), NOT BY US"
)
ARTIFACT_LABEL = (
    "OUR ARTIFACT FLOOR %.0f-%.0f t/h — spurious flux THIS CHAIN reports on METERED-ZERO scenes (n=%d).\n"
    "A LIMITATION OF OUR PIPELINE, NOT A MEASUREMENT OF AN EMISSION. "
    "All of it was withheld by the honesty gates."
)


def noise_scenes(keys: DataFrame, runs: DataFrame, basins: DataFrame, vza: float = NOMINAL_VZA_DEG) -> DataFrame:
    """Each measured-noise key with the geometry of its own run, or the nominal geometry.

    ``keys``: ``key, sigma``. ``runs``: ``event_id, basin, det_date, status,
    lat, lon, u10_ms, cloud_screening, target_scene, background_scene`` and
    optionally ``sigma``, the noise that the gates recorded on the run.
    ``basins``: ``basin, lon_min, lat_min, lon_max, lat_max, surface_class, pressure``.
    """
    part = noise_key(F.col("key"))
    k = keys.select("key", "sigma", *[v.alias(n) for n, v in part.items()]).where(
        F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("bad noise key "), F.col("key"))).cast("boolean"))
    )
    r = runs.select(
        F.col("basin").alias("r_basin"), F.col("det_date").alias("r_day"), "event_id", "status", "lat", "lon", "u10_ms",
        F.coalesce("cloud_screening", F.lit(False)).alias("screened"), "target_scene", acquisition_time("target_scene").alias("acquired"),
        F.datediff(acquisition_time("target_scene"), acquisition_time("background_scene")).alias("gap"),
        (F.col("sigma") if "sigma" in runs.columns else F.lit(None).cast("double")).alias("recorded"),
    )
    best = F.min_by(
        F.struct("event_id", "status", "lat", "lon", "u10_ms", "target_scene", "acquired", "recorded"),
        F.struct((F.col("status") != "quotable").alias("late"), "event_id"),
    ).alias("run")
    # The best run of every (basin, day, screening, gap), then of every combination of them that a key may leave open:
    # minima that combine before the shuffle, so a key meets one row whatever its basin and day hold.
    place = ["r_basin", "r_day"]
    one = r.groupBy(*place, "screened", "gap").agg(best).select(*place, "screened", "gap", "run.*")
    screens = F.explode(F.array(F.lit(ANY), F.col("screened").cast("string"))).alias("_screen")
    gaps = F.explode(F.when(F.col("gap").isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.lit(ANY), F.col("gap").cast("string")))).alias("_gap")
    open_ = one.select("*", screens).select("*", gaps).groupBy(*place, "_screen", "_gap").agg(best)
    asked = k.drop("ok").withColumns({
        "r_basin": F.col("basin"), "r_day": F.col("day"),
        "_screen": F.coalesce(F.col("cloud_screened").cast("string"), F.lit(ANY)), "_gap": F.coalesce(F.col("baseline_days").cast("string"), F.lit(ANY)),
    })
    chosen = asked.join(open_, [*place, "_screen", "_gap"], "left").drop(*place, "_screen", "_gap")
    b = basins.select(
        "basin", ((F.col("lon_min") + F.col("lon_max")) / 2).alias("b_lon"),
        ((F.col("lat_min") + F.col("lat_max")) / 2).alias("b_lat"), "surface_class", "pressure",
    )
    out = chosen.join(b, "basin", "left")
    own = F.col("run.lat").isNotNull() & F.col("run.lon").isNotNull()
    lat = F.when(own, F.col("run.lat")).otherwise(F.col("b_lat"))
    lon = F.when(own, F.col("run.lon")).otherwise(F.col("b_lon"))
    lat = F.when(lat.isNotNull(), lat).otherwise(
        F.raise_error(F.concat(F.lit("no position for noise key "), F.col("key"))).cast("double")
    )
    out = out.withColumn("lat", lat).withColumn("lon", lon)
    stamped = F.col("run.acquired").isNotNull()
    # Wall-clock parts keep the UTC stamp independent of the session time zone.
    at = F.col("run.acquired")
    clock = F.unix_date(F.to_date(at)) * 86400.0 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    seconds = F.when(stamped, clock).otherwise(
        nominal_overpass_seconds("day", "lon")
    )
    return out.select(
        "key", "basin", "day", "sigma", "cloud_screened", "baseline_days", "lat", "lon",
        F.coalesce("surface_class", F.lit("unknown")).alias("surface_class"),
        F.coalesce("pressure", F.lit(1013.0)).alias("pressure"),
        F.when(stamped, platform("run.target_scene")).otherwise(NOMINAL_SATELLITE).alias("satellite"),
        solar_zenith_deg(seconds, "lat", "lon").alias("sza"), F.lit(float(vza)).alias("vza"),
        F.coalesce(F.nullif("run.u10_ms", F.lit(0.0)), F.lit(DEFAULT_U10)).alias("u10"),
        F.when(stamped, "scene_timestamp").otherwise("nominal_overpass").alias("geometry_source"),
        F.col("run.event_id").alias("event_id"), F.coalesce("run.status", F.lit("absent")).alias("run_status"),
        F.col("run.recorded").alias("recorded_sigma_ppb"), F.coalesce(F.col("run.status") == "quotable", F.lit(True)).alias("quotable"),
        F.lit(1).alias("n_scenes"), F.lit(True).alias("provisional"),
    )


def scene_label(scenes: DataFrame) -> DataFrame:
    """Add the figure label that keeps screening, baseline and run status visible."""
    screen = F.when(F.col("cloud_screened"), "cloud-screened").when(~F.col("cloud_screened"), "UNSCREENED").otherwise("screening n/k")
    base = F.when(F.col("baseline_days") > 0, F.format_string(", %d d baseline", "baseline_days")).otherwise("")
    status = F.when(F.col("run_status").isin("quotable", "absent"), "").otherwise(
        F.concat(F.lit(" ["), F.upper("run_status"), F.lit(" RUN]"))
    )
    return scenes.withColumn(
        "label",
        F.concat("basin", F.lit(" "), F.date_format("day", "yyyy-MM-dd"), F.lit(" ("), screen, base, F.lit(", n=1)"), status),
    ).withColumn("provisional", F.col("n_scenes") < 2)


def with_sigma_ppb(scenes: DataFrame, calibration: DataFrame) -> DataFrame:
    """Add ``sigma_ppb``: the log-ratio noise mapped through each scene's own response curve."""
    curves = attach_curve(scenes, calibration)
    return curves.withColumn("sigma_ppb", F.abs(cubic_ppb("sigma", "c1", "c2", "c3"))).drop("c1", "c2", "c3")


def qmin_curve(
    scenes: DataFrame, u10_grid: list[float], k: float = 3.0, min_pixels: int = MIN_PIXELS,
    pixel_size: float = 20.0, length="length_m",
) -> DataFrame:
    """Limit per scene over a wind grid; input carries ``sigma_ppb, pressure`` and the length column."""
    grid = F.explode(F.array(*[F.lit(float(u)) for u in u10_grid])).alias("u10_grid")
    return scenes.select("*", grid).withColumn(
        "q_min_kg_h",
        detection_limit(
            "sigma_ppb", "u10_grid", k=k, min_pixels=min_pixels, pixel_area=pixel_size**2, length=length, pressure="pressure"
        ),
    )


def min_pixel_sensitivity(scenes: DataFrame, pixels=MIN_PIXEL_SENSITIVITY, k: float = 3.0, pixel_size: float = 20.0) -> DataFrame:
    """Limit (t/h) at each scene's own wind for several minimum mask sizes."""
    n = F.explode(F.array(*[F.lit(p) for p in pixels])).alias("min_pixels")
    q = detection_limit(
        "sigma_ppb", "u10", k=k, min_pixels="min_pixels", pixel_area=pixel_size**2, length="length_m", pressure="pressure"
    )
    return scenes.select("*", n).withColumn("qmin_t_h", F.round(q / 1000.0, 3))


def limit_surface(
    basins: DataFrame, seasons: DataFrame, winds: DataFrame, sigmas: DataFrame, lengths: DataFrame,
    k: float = 3.0, min_pixels: int = MIN_PIXELS, pixel_size: float = 20.0,
) -> DataFrame:
    """Limit per basin and season; seasons without noise are left out, missing wind is 3 m/s.

    All inputs are dimension tables (basins, seasons, surface classes).
    """
    known = sigmas.join(seasons, "season", "left_semi")
    grid = basins.join(known, "surface_class").join(winds, ["basin", "season"], "left").join(
        lengths, "surface_class", "left"
    )
    q = detection_limit(
        "sigma_ppb", F.coalesce("u10", F.lit(DEFAULT_U10)), k=k, min_pixels=min_pixels,
        pixel_area=pixel_size**2, length=F.coalesce("length_m", F.lit(1000.0)),
    )
    return grid.select("basin", "season", F.round(q, 1).alias("q_min_kg_h"))


def community_floor(overpasses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(smallest positive metered release per campaign, their range with its label)."""
    members = (
        overpasses.where((F.col("kind") == "release") & (F.col("kg_h") > 0))
        .groupBy("campaign").agg((F.min("kg_h") / 1000.0).alias("t_h"))
    )
    return members, _floor(members, COMMUNITY_LABEL, "published by others (measured)", False)


def artifact_floor(overpasses: DataFrame, runs: DataFrame, kinds=("zero_control",)) -> tuple[DataFrame, DataFrame]:
    """(withheld flux per metered-zero run, their range with its label).

    ``runs``: ``event_id, campaign, det_date, q_withheld``.
    """
    wanted = overpasses.where(F.col("kind").isin(*kinds)).select("campaign", F.col("date").alias("det_date"))
    members = (
        runs.join(wanted, ["campaign", "det_date"], "left_semi").where(F.col("q_withheld") > 0)
        .select("event_id", (F.col("q_withheld") / 1000.0).alias("t_h"))
    )
    return members, _floor(members, ARTIFACT_LABEL, "ours (measured, artifact)", True)


def _floor(members: DataFrame, label: str, attribution: str, count: bool) -> DataFrame:
    out = members.agg(F.min("t_h").alias("low_t_h"), F.max("t_h").alias("high_t_h"), F.count(F.lit(1)).alias("n"))
    args = ["low_t_h", "high_t_h"] + (["n"] if count else [])
    present = F.when(F.col("n") > 0, F.format_string(label, *args)).otherwise(
        F.raise_error(F.lit("no measurements for this floor")).cast("string")
    )
    return out.select("*", present.alias("label"), F.lit(attribution).alias("attribution"))


def atlas_summary(scenes: DataFrame, calibration: DataFrame, lengths: DataFrame, k: float = 3.0) -> DataFrame:
    """One row per noise scene with every published number and a JSON form of the size fan."""
    s = with_sigma_ppb(scene_label(scenes), calibration).join(F.broadcast(lengths), "surface_class", "left")
    s = s.withColumn("length_m", F.coalesce("length_m", F.lit(1000.0)))

    def q(n):
        limit = detection_limit("sigma_ppb", "u10", k=k, min_pixels=n, length="length_m", pressure="pressure")
        return F.round(limit / 1000.0, 3)

    assumed = F.create_map(*[x for c, v in ASSUMED_SIGMA_PPB.items() for x in (F.lit(c), F.lit(v))])
    return s.select(
        "key", "label", "basin", "surface_class", "day", "n_scenes", "provisional",
        F.col("event_id").alias("source_run"), "run_status", "geometry_source", "satellite",
        F.round("sza", 2).alias("sza_deg"), "vza", "u10", "pressure", "length_m",
        F.col("sigma").alias("sigma_log_ratio"), F.round("sigma_ppb", 1).alias("sigma_ppb"),
        F.try_element_at(assumed, F.col("surface_class")).alias("sigma_ppb_assumed"),
        q(MIN_PIXELS).alias("qmin_t_h"),
        F.to_json(F.struct(*[q(n).alias(str(n)) for n in MIN_PIXEL_SENSITIVITY])).alias("qmin_by_pixels"),
    )
