"""Queries for quantification, gates and detection limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import limits, quantify, report
from .registry import Tables, query, r6
from .sqltext import INTERP, SOLAR_STEPS, mass

_LIMIT = "({m}) * ({n} * 400.0) * (0.33 * {u} + 0.45) * 3600 / greatest({l}, sqrt({n} * 400.0))"


def limit_sql(sigma: str, u: str, n: str = "25", length: str = "1000.0", pressure: str = "1013.0") -> str:
    return _LIMIT.format(m=mass(f"3 * {sigma}", pressure), n=n, u=u, l=length)


_IME = f"""SELECT scene_id, round(coalesce(sum(CASE WHEN core THEN {mass('value')} END), 0) * 400, 4) AS ime_kg,
  count(CASE WHEN core THEN 1 END) AS n_pixels FROM v_scene GROUP BY 1"""


@query("integrated_mass", _IME)
def integrated_mass(t: Tables):
    m = quantify.integrated_mass(t.v_scene, ["scene_id"], 400.0, "core")
    return m.select("scene_id", r6("ime_kg", 4).alias("ime_kg"), "n_pixels")


_UW = """((concat('0x', substr(md5(concat('20270307-', s.scene_id, '-', s.draw, '-wind-{ab}')), 1, 8))::bigint + 0.5) / 4294967296.0)"""
_GW = "sqrt(-2 * ln(" + _UW.format(ab="a") + ")) * cos(2 * pi() * " + _UW.format(ab="b") + ")"


#: The counted draws of every mask pixel: u0 keeps it, u1 and u2 make its noise.
_DRAWS = """px AS (SELECT scene_id, value, concat('0x', substr(md5(concat_ws('-', 20270307, scene_id, row, col, 'pixel')), 1, 8))::bigint::ubigint AS base FROM v_scene WHERE core),
 h0 AS (SELECT scene_id, value, draw, j, base, (base + (draw * 3 + j + 1)::ubigint * 2654435769::ubigint) & 4294967295::ubigint AS h
   FROM px, (SELECT unnest(range(500)) AS draw), (SELECT unnest(range(3)) AS j)),
 h1 AS (SELECT * REPLACE ((xor(h, h >> 16::ubigint) * 2246822507::ubigint) & 4294967295::ubigint AS h) FROM h0),
 h2 AS (SELECT * REPLACE ((xor(h, h >> 13::ubigint) * 3266489909::ubigint) & 4294967295::ubigint AS h) FROM h1),
 h3 AS (SELECT scene_id, value, draw, j, base, (xor(h, h >> 16::ubigint) + 0.5) / 4294967296.0 AS u FROM h2),
 dr AS (SELECT scene_id, draw, base, any_value(value) AS value, max(CASE j WHEN 0 THEN u END) AS u0, max(CASE j WHEN 1 THEN u END) AS u1, max(CASE j WHEN 2 THEN u END) AS u2 FROM h3 GROUP BY 1, 2, 3),
 sums AS (SELECT scene_id, draw, sum(""" + mass("value + 15 * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)") + """) AS m, count(*) AS n FROM dr WHERE u0 < 0.9 GROUP BY 1, 2),
 qs AS (SELECT s.scene_id, coalesce(m, 0) * 400 * (0.33 * (2e0 + s.scene_id % 6) + 0.45) * least(greatest(1 + 0.25 * """ + _GW + """, 0.5), 1.5) * 3600
      / sqrt(greatest(coalesce(n, 0), 1) * 400.0) AS q
   FROM (SELECT DISTINCT scene_id, draw FROM v_scene, (SELECT unnest(range(500)) AS draw) WHERE core) s
   LEFT JOIN sums x ON x.scene_id = s.scene_id AND x.draw = s.draw),
 ci AS (SELECT scene_id, quantile_cont(q, 0.025) AS ci_low, quantile_cont(q, 0.975) AS ci_high, count(*) AS draws FROM qs GROUP BY 1)"""


@query("rate_monte_carlo", "SELECT scene_id, round(ci_low, 3) AS ci_low, round(ci_high, 3) AS ci_high, draws FROM ci", extra=_DRAWS)
def rate_monte_carlo(t: Tables):
    out = quantify.rate_monte_carlo(t.v_scene, ["scene_id"], _u10(t), 400.0, mask="core")
    return out.select("scene_id", r6("ci_low", 3).alias("ci_low"), r6("ci_high", 3).alias("ci_high"), "draws")


def _u10(t: Tables):
    return t.v_scene.select("scene_id").distinct().withColumn("u10", 2.0 + F.col("scene_id") % 6)


@query(
    "rate_record",
    f"""SELECT scene_id, round(ime * ueff * 3600 / length, 3) AS q_kg_h, round(coalesce(ci_low, 0), 3) AS ci_low, round(coalesce(ci_high, 0), 3) AS ci_high,
         round(ime, 6) AS ime_kg, round(ueff, 6) AS ueff_ms, round(length, 6) AS length_m, n_pixels
       FROM (SELECT scene_id, coalesce(sum(CASE WHEN core THEN {mass('value')} END), 0) * 400 AS ime, 0.33 * (2e0 + scene_id % 6) + 0.45 AS ueff,
              sqrt(greatest(count(CASE WHEN core THEN 1 END), 1) * 400.0) AS length, count(CASE WHEN core THEN 1 END) AS n_pixels FROM v_scene GROUP BY scene_id) p
       LEFT JOIN ci USING (scene_id)""",
    extra=_DRAWS,
)
def rate_record(t: Tables):
    out = quantify.rate_record(t.v_scene, ["scene_id"], _u10(t), 400.0, mask="core")
    return out.select("scene_id", *[r6(c, 3).alias(c) for c in ("q_kg_h", "ci_low", "ci_high")], *[r6(c).alias(c) for c in ("ime_kg", "ueff_ms", "length_m")], "n_pixels")


_GATES = """gs AS (SELECT scene_id, value, core, valid, quantile_cont(CASE WHEN valid AND NOT core THEN value END, 0.5) OVER (PARTITION BY scene_id) AS m FROM v_scene),
 g AS (SELECT scene_id, count(CASE WHEN valid THEN 1 END) AS n_window_px, count(CASE WHEN valid AND core THEN 1 END) AS n_mask_px,
   avg(CASE WHEN valid AND core THEN value END) AS mean_ppb,
   greatest(1.4826 * quantile_cont(CASE WHEN valid AND NOT core THEN abs(value - m) END, 0.5), 2.0) AS sigma FROM gs GROUP BY 1),
 gv AS (SELECT *, n_mask_px / n_window_px AS fraction FROM g)"""


@query(
    "honesty_gates",
    """SELECT scene_id, n_window_px, n_mask_px, round(mean_ppb * n_mask_px, 4) AS mask_ppb_sum, round(sigma, 6) AS sigma, round(fraction, 6) AS fraction,
         concat_ws('|', CASE WHEN mean_ppb > 200 THEN printf('mean in-mask enhancement %.0f ppb is %.1fx the ambient column — unphysical for a point source (limit 200 ppb)', mean_ppb, mean_ppb / 1800) END,
                   CASE WHEN sigma > 500 THEN printf('sigma_col %.1f ppb > 500 ppb limit', sigma) END,
                   CASE WHEN fraction > 0.1 THEN printf('plume mask %.1f%% of window > 10%% limit', fraction * 100) END) AS reasons,
         CASE WHEN mean_ppb > 200 OR sigma > 500 OR fraction > 0.1 THEN 'ARTIFACT-DOMINATED — quantification withheld'
              ELSE 'gates passed — quantification permitted' END AS verdict FROM gv""",
    extra=_GATES,
)
def honesty_gates(t: Tables):
    g = quantify.honesty_gates(
        t.v_scene, ["scene_id"], mask="core", sigma_limit=500.0, fraction_limit=0.1, mean_ratio=200.0 / 1800.0
    )
    return g.select(
        "scene_id", "n_window_px", "n_mask_px", r6(F.col("mean_enhancement_ppb") * F.col("n_mask_px"), 4).alias("mask_ppb_sum"), r6("sigma_col_ppb").alias("sigma"),
        r6("mask_fraction").alias("fraction"), F.array_join("reasons", "|").alias("reasons"), "verdict",
    )


@query(
    "quant_withhold",
    f"""SELECT gv.scene_id, CASE WHEN n_pixels >= 20 AND NOT bad THEN ime_kg END AS mass, CASE WHEN n_pixels >= 20 AND bad THEN ime_kg END AS mass_withheld
        FROM (SELECT *, coalesce(mean_ppb > 200, false) OR sigma > 500 OR fraction > 0.1 AS bad FROM gv) gv JOIN ({_IME}) i ON i.scene_id = gv.scene_id""",
    extra=_GATES,
)
def quant_withhold(t: Tables):
    g = quantify.honesty_gates(
        t.v_scene, ["scene_id"], mask="core", sigma_limit=500.0, fraction_limit=0.1, mean_ratio=200.0 / 1800.0
    ).select("scene_id", "artifact_dominated")
    m = quantify.integrated_mass(t.v_scene, ["scene_id"], 400.0, "core").join(g, "scene_id")
    ok, held = report.withhold(r6("ime_kg", 4), F.col("n_pixels"), F.col("artifact_dominated"))
    return m.select("scene_id", ok.alias("mass"), held.alias("mass_withheld"))


_ALT = "(8.0 * (1e-6 * 1000.0 / 22.4 * 0.01604))"


@query(
    "flux_audit",
    f"""SELECT event_id, q_kg_h AS q_kg_h, round(mean, 4) AS mean_ppb, round(q_kg_h / 1e3 / cat, 4) AS ratio,
          round(npix / 640000.0, 6) AS mask_fraction, round(mean / 1800, 6) AS factor, round(mean / (q_kg_h / 1e3 / cat), 4) AS mean_for_catalog,
          round(pow(q_kg_h / 1e3 / cat, 2), 3) AS shrink,
          cast(abs(mean * {_ALT} * npix * 400 - ime) / ime > 0.01 AS int) + cast(abs(sqrt(npix * 400.0) - l) > 1 AS int) AS n_notes
        FROM (SELECT *, q_kg_h * 0.123456789 / 8.0 / npix AS mean, CASE WHEN withheld THEN NULL ELSE 1037e-2 + run_key % 50 END AS cat,
                q_kg_h * 0.123456789 / 8.0 * {_ALT} * 400 * CASE WHEN run_key % 3 = 0 THEN 1.2 ELSE 1 END AS ime,
                sqrt(npix * 400.0) + CASE WHEN run_key % 5 = 0 THEN 3 ELSE 0 END AS l FROM v_runs)""",
)
def flux_audit(t: Tables):
    from ..functions.retrieval import ALT_KG_M2_PER_PPB

    k = F.col("run_key")
    text = F.to_json(F.struct(
        F.col("q_kg_h").alias("Q"), (F.sqrt(F.col("npix") * 400.0) + F.when(k % 5 == 0, 3).otherwise(0)).alias("L"),
        F.col("npix").alias("npix_plume"),
        (F.col("q_kg_h") * 0.123456789 / 8.0 * ALT_KG_M2_PER_PPB * 400 * F.when(k % 3 == 0, 1.2).otherwise(1.0)).alias("IME"),
        (F.col("q_kg_h") * 0.123456789).alias("sum_enhancement"), F.lit(400.0).alias("pixel_size"), F.lit(2.0).alias("u_eff"),
    ))
    runs = t.v_runs.select("event_id", F.from_json(
        text, "Q double, L double, npix_plume long, IME double, sum_enhancement double, pixel_size double, u_eff double"
    ).alias("o"), F.when(~F.col("withheld"), 10.37 + k % 50).alias("catalog_t_h")).select(
        "event_id", F.col("o.Q").alias("q"), F.col("o.L").alias("l"), F.col("o.npix_plume").alias("npix"), F.col("o.IME").alias("ime"),
        "o.sum_enhancement", "o.pixel_size", "o.u_eff", "catalog_t_h", F.lit(640000).alias("window_px"),
    )
    a = quantify.flux_audit(runs)
    return a.select(
        "event_id", r6(F.col("q_t_h") * 1e3, 2).alias("q_kg_h"), r6("mean_enhancement_ppb", 4).alias("mean_ppb"), r6("ratio_to_catalog", 4).alias("ratio"),
        r6("mask_fraction").alias("mask_fraction"), r6("column_enhancement_factor").alias("factor"),
        r6("mean_ppb_for_catalog_rate", 4).alias("mean_for_catalog"), r6("mask_shrink_for_catalog_rate", 3).alias("shrink"),
        F.size("notes").alias("n_notes"),
    )


_TRUTH = """tc AS (SELECT t.overpass_key, t.campaign, t.date, t.kind, t.kg_h, r.is_plume, CASE WHEN r.withheld THEN NULL ELSE r.q_kg_h END AS q,
     CASE WHEN r.withheld THEN r.q_kg_h END AS qw FROM v_truth t LEFT JOIN (SELECT * FROM v_runs WHERE readable) r ON r.campaign = t.campaign AND r.det_date = t.date)"""


def _truth_runs(t: Tables):
    runs = t.v_runs.where("readable").select(
        "campaign", "det_date", "is_plume", F.when(~F.col("withheld"), F.col("q_kg_h")).alias("q_kg_h"),
        F.when(F.col("withheld"), F.col("q_kg_h")).alias("q_withheld"), F.col("run_key"),
    )
    return quantify.truth_compare(t.v_truth, runs)


@query(
    "truth_compare",
    """SELECT overpass_key, kind, kg_h, coalesce(q, qw) AS retrieved_kg_h, q IS NULL AND qw IS NOT NULL AS withheld,
              CASE WHEN kg_h <> 0 THEN round(coalesce(q, qw) / kg_h, 6) END AS ratio FROM tc""",
    extra=_TRUTH,
)
def truth_compare(t: Tables):
    return _truth_runs(t).select(
        "overpass_key", "kind", "kg_h", "retrieved_kg_h", F.col("quantification_withheld").alias("withheld"), r6("ratio").alias("ratio")
    )


@query(
    "zero_control_summary",
    """SELECT count(*) AS n_runs, count(CASE WHEN is_plume THEN 1 END) AS n_false, min(CASE WHEN is_plume THEN g END) AS false_min,
              round(quantile_cont(CASE WHEN is_plume THEN g END, 0.5), 6) AS false_median, max(CASE WHEN is_plume THEN g END) AS false_max
       FROM (SELECT *, coalesce(q, qw) AS g FROM tc WHERE kind IN ('zero_control', 'no_release')) WHERE g IS NOT NULL""",
    extra=_TRUTH,
)
def zero_control_summary(t: Tables):
    return quantify.zero_control_summary(_truth_runs(t)).withColumn("false_median", r6("false_median"))


@query(
    "community_floor",
    """SELECT round(min(t), 6) AS low_t_h, round(max(t), 6) AS high_t_h, count(*) AS n,
         concat('COMMUNITY DETECTION FLOOR ', printf('%.1f', min(t)), '-', printf('%.1f', max(t)), ' t/h — DEMONSTRATED BY PUBLISHED TEAMS (Sherwin et al. 2023/2024), NOT BY US') AS label
       FROM (SELECT campaign, min(kg_h) / 1000 AS t FROM v_truth WHERE kind = 'release' AND kg_h > 0 GROUP BY 1)""",
)
def community_floor(t: Tables):
    _, floor = limits.community_floor(t.v_truth)
    return floor.select(r6("low_t_h").alias("low_t_h"), r6("high_t_h").alias("high_t_h"), "n", "label")


@query(
    "artifact_floor",
    """SELECT round(min(t), 6) AS low_t_h, round(max(t), 6) AS high_t_h, count(*) AS n, 'ours (measured, artifact)' AS attribution,
         printf('OUR ARTIFACT FLOOR %.0f-%.0f t/h — spurious flux THIS CHAIN reports on METERED-ZERO scenes (n=%d).', min(t), max(t), count(*)) || chr(10)
           || 'A LIMITATION OF OUR PIPELINE, NOT A MEASUREMENT OF AN EMISSION. All of it was withheld by the honesty gates.' AS label
       FROM (SELECT q_kg_h / 1000 AS t FROM v_runs r
       WHERE withheld AND q_kg_h > 0 AND EXISTS (SELECT 1 FROM v_truth t WHERE t.kind = 'zero_control' AND t.campaign = r.campaign AND t.date = r.det_date))""",
)
def artifact_floor(t: Tables):
    runs = t.v_runs.select("event_id", "campaign", "det_date", F.when(F.col("withheld"), F.col("q_kg_h")).alias("q_withheld"))
    _, floor = limits.artifact_floor(t.v_truth, runs)
    return floor.select(r6("low_t_h").alias("low_t_h"), r6("high_t_h").alias("high_t_h"), "n", "attribution", "label")


@query(
    "artifact_floor_members",
    """SELECT event_id, round(q_kg_h / 1000, 6) AS t_h FROM v_runs r WHERE withheld AND q_kg_h > 0
       AND EXISTS (SELECT 1 FROM v_truth t WHERE t.kind = 'zero_control' AND t.campaign = r.campaign AND t.date = r.det_date)""",
)
def artifact_floor_members(t: Tables):
    runs = t.v_runs.select("event_id", "campaign", "det_date", F.when(F.col("withheld"), F.col("q_kg_h")).alias("q_withheld"))
    members, _ = limits.artifact_floor(t.v_truth, runs)
    return members.select("event_id", r6("t_h").alias("t_h"))


@query(
    "detection_limit",
    f"SELECT event_id, round({limit_sql('(1 + npix / 10.0)', 'coalesce(u10, 3)', 'npix')}, 4) AS q_min FROM v_runs",
)
def detection_limit(t: Tables):
    q = quantify.detection_limit(1 + F.col("npix") / 10.0, F.coalesce("u10", F.lit(3.0)), min_pixels="npix")
    return t.v_runs.select("event_id", r6(q, 4).alias("q_min"))


_NOISE = """nk AS (SELECT key, sigma, split_part(key, '_', 1) AS basin, cast(split_part(key, '_', 2) AS date) AS day,
    CASE WHEN key LIKE '%cloudscreened%' THEN true WHEN key LIKE '%unscreened%' THEN false END AS screened,
    CASE WHEN key LIKE '%_10d' THEN 10 WHEN key LIKE '%_20d' THEN 20 END AS days FROM v_noise_keys),
 fits AS (SELECT k.key, r.*, r.target_scene <> '' AS stamped, row_number() OVER (PARTITION BY k.key ORDER BY r.status <> 'quotable', r.event_id) AS rn
    FROM nk k JOIN v_noise_runs r ON r.basin = k.basin AND r.det_date = k.day AND (k.screened IS NULL OR r.cloud_screening = k.screened)
    AND (k.days IS NULL OR (r.target_scene <> '' AND k.days = CASE r.run_key % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END))),
 ns AS (SELECT k.*, f.event_id, f.sigma AS recorded, coalesce(f.status, 'absent') AS run_status, coalesce(f.stamped, false) AS stamped,
    CASE WHEN f.lat IS NOT NULL THEN f.lat ELSE (b.lat_min + b.lat_max) / 2 END AS lat, CASE WHEN f.lat IS NOT NULL THEN f.lon ELSE (b.lon_min + b.lon_max) / 2 END AS lon,
    coalesce(nullif(f.u10_ms, 0), 3.0) AS u10, coalesce(b.surface_class, 'unknown') AS surface_class, coalesce(b.pressure, 1013.0) AS pressure
    FROM nk k LEFT JOIN fits f ON f.key = k.key AND f.rn = 1 LEFT JOIN v_noise_basins b ON b.basin = k.basin),
 sun AS (SELECT key AS event_key, lat, lon, CASE WHEN stamped THEN 20103 + (10 * 3600 + 10 * 60 + 31) / 86400.0
      ELSE date_diff('day', DATE '1970-01-01', day) + (10.5 - lon / 15) / 24 END + (2440587.5 - 2451545.0) AS n FROM ns),""" + SOLAR_STEPS + """,
 geom AS (SELECT ns.*, degrees(acos(least(1, greatest(-1, upward)))) AS sza FROM ns JOIN sky ON sky.event_key = ns.key)"""


def noise_scenes(t: Tables):
    return limits.noise_scenes(t.v_noise_keys, t.v_noise_runs, t.v_noise_basins)


@query(
    "noise_scene_join",
    """SELECT key, round(lat, 4) AS lat, round(lon, 4) AS lon, round(sza, 3) AS sza, u10, surface_class, pressure, coalesce(event_id, '') AS event_id, run_status,
              CASE WHEN stamped THEN 'S2A' ELSE 'S2B' END AS satellite,
              CASE WHEN stamped THEN 'scene_timestamp' ELSE 'nominal_overpass' END AS geometry_source,
              round(coalesce(recorded, -1), 6) AS recorded_sigma, run_status IN ('quotable', 'absent') AS quotable FROM geom""",
    extra=_NOISE,
)
def noise_scene_join(t: Tables):
    return noise_scenes(t).select(
        "key", r6("lat", 4).alias("lat"), r6("lon", 4).alias("lon"), r6("sza", 3).alias("sza"), "u10", "surface_class", "pressure",
        F.coalesce("event_id", F.lit("")).alias("event_id"), "run_status", "satellite", "geometry_source", r6(F.coalesce("recorded_sigma_ppb", F.lit(-1.0))).alias("recorded_sigma"), "quotable",
    )


_ATLAS = _NOISE + """, cal AS (SELECT * FROM v_calibration),
 scenes AS (SELECT key AS scene_key, CASE WHEN stamped THEN 'S2A' ELSE 'S2B' END AS satellite, sza, 5e0 AS vza, sigma AS log_ratio FROM geom),""" + INTERP + """,
 sig AS (SELECT g.*, c1 * log_ratio + c2 * pow(log_ratio, 2) + c3 * pow(log_ratio, 3) AS sigma_ppb,
    CASE surface_class WHEN 'homogeneous_arid' THEN 1000.0 WHEN 'heterogeneous' THEN 600.0 ELSE 1000.0 END AS length_m
    FROM geom g JOIN curve ON curve.scene_key = g.key)"""


def _lengths(t: Tables):
    classes = t.v_noise_basins.select("surface_class").distinct()
    return classes.withColumn("length_m", F.when(F.col("surface_class") == "heterogeneous", 600.0).otherwise(1000.0))


def _with_lengths(t: Tables):
    s = limits.with_sigma_ppb(noise_scenes(t), t.v_calibration)
    return s.join(F.broadcast(_lengths(t)), "surface_class", "left").withColumn("length_m", F.coalesce("length_m", F.lit(1000.0)))


@query(
    "qmin_curve",
    f"SELECT key, u AS u10_grid, round({limit_sql('sigma_ppb', 'u', '25', 'length_m', 'pressure')}, 3) AS q_min_kg_h FROM sig, (SELECT unnest([1e0, 2e0, 4e0, 8e0]) AS u)",
    extra=_ATLAS,
)
def qmin_curve(t: Tables):
    out = limits.qmin_curve(_with_lengths(t), [1, 2, 4, 8])
    return out.select("key", "u10_grid", r6("q_min_kg_h", 3).alias("q_min_kg_h"))


@query(
    "min_pixel_sensitivity",
    f"SELECT key, n AS min_pixels, round({limit_sql('sigma_ppb', 'u10', 'n', 'length_m', 'pressure')} / 1000, 3) AS qmin_t_h FROM sig, (SELECT unnest([9, 25, 100]) AS n)",
    extra=_ATLAS,
)
def min_pixel_sensitivity(t: Tables):
    return limits.min_pixel_sensitivity(_with_lengths(t)).select("key", "min_pixels", "qmin_t_h")


@query(
    "atlas_summary",
    f"""SELECT key, concat(basin, ' ', cast(day AS varchar), ' (', CASE WHEN screened THEN 'cloud-screened' WHEN NOT screened THEN 'UNSCREENED' ELSE 'screening n/k' END,
           CASE WHEN days > 0 THEN concat(', ', days, ' d baseline') ELSE '' END, ', n=1)',
           CASE WHEN run_status IN ('quotable', 'absent') THEN '' ELSE concat(' [', upper(run_status), ' RUN]') END) AS label,
         round(sigma_ppb, 1) AS sigma_ppb, CASE surface_class WHEN 'homogeneous_arid' THEN 12.0 WHEN 'heterogeneous' THEN 25.0 END AS assumed,
         round({limit_sql('sigma_ppb', 'u10', '25', 'length_m', 'pressure')} / 1000, 3) AS qmin_t_h,
         round({limit_sql('sigma_ppb', 'u10', '100', 'length_m', 'pressure')} / 1000, 3) AS qmin_100 FROM sig""",
    extra=_ATLAS,
)
def atlas_summary(t: Tables):
    a = limits.atlas_summary(noise_scenes(t), t.v_calibration, _lengths(t))
    return a.select(
        "key", "label", "sigma_ppb", F.col("sigma_ppb_assumed").alias("assumed"), "qmin_t_h",
        F.get_json_object("qmin_by_pixels", "$.100").cast("double").alias("qmin_100"),
    )


_SURF = """bs AS (SELECT basin, surface_class FROM v_noise_basins),
 wi AS (SELECT concat('C', cast(o_custkey AS varchar)) AS basin, quarter(o_orderdate) AS season, avg(1 + o_orderkey % 9) AS u FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
 sg AS (SELECT surface_class, season, 10e0 + max(o_orderkey % 50) AS s FROM (SELECT o_orderkey, quarter(o_orderdate) AS season,
    CASE WHEN c_nationkey % 2 = 0 THEN 'homogeneous_arid' ELSE 'heterogeneous' END AS surface_class FROM orders JOIN customer ON c_custkey = o_custkey)
    WHERE NOT (season = 4 AND surface_class = 'heterogeneous') GROUP BY 1, 2)"""


@query(
    "limit_surface",
    f"""SELECT b.basin, g.season, round({limit_sql('g.s', 'coalesce(w.u, 3.0)', '25', "CASE WHEN b.surface_class = 'heterogeneous' THEN 600.0 ELSE 1000.0 END")}, 1) AS q_min_kg_h
        FROM bs b JOIN sg g ON g.surface_class = b.surface_class LEFT JOIN wi w ON w.basin = b.basin AND w.season = g.season""",
    extra=_SURF,
)
def limit_surface(t: Tables):
    key = F.col("o_orderkey")
    orders = t.orders.withColumn("season", F.quarter("o_orderdate"))
    winds = orders.where("o_orderstatus = 'F'").groupBy(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("basin"), "season"
    ).agg(F.avg(1 + key % 9).alias("u10"))
    cls = F.when(F.col("c_nationkey") % 2 == 0, "homogeneous_arid").otherwise("heterogeneous")
    sigma = (
        orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(cls.alias("surface_class"), "season")
        .agg((F.max(key % 50) + 10.0).alias("sigma_ppb")).where("NOT (season = 4 AND surface_class = 'heterogeneous')")
    )
    seasons = orders.select("season").distinct()
    return limits.limit_surface(t.v_noise_basins.select("basin", "surface_class"), seasons, winds, sigma, _lengths(t))


@query(
    "scale_verdict",
    """SELECT pass_id, target_id, round(p99, 3) AS p99, round(ff, 6) AS finite_fraction, CASE WHEN p99 <= 1.5 THEN 'reflectance' WHEN p99 >= 20 THEN 'dn' ELSE 'indeterminate' END AS scale
       FROM (SELECT pass_id, target_id, quantile_cont(v, 0.99) AS p99, count(v) / count(*) AS ff FROM
         (SELECT pass_id, target_id, CASE WHEN valid THEN CASE pass_id % 3 WHEN 0 THEN b11 / 1e5 WHEN 1 THEN b11 ELSE b11 / 1e4 END END AS v FROM v_bands) GROUP BY 1, 2)""",
)
def scale_verdict(t: Tables):
    k = F.col("pass_id") % 3
    v = F.when(F.col("valid"), F.when(k == 0, F.col("b11") / 1e5).when(k == 1, F.col("b11")).otherwise(F.col("b11") / 1e4))
    out = quantify.scale_verdict(t.v_bands.withColumn("value", v), ["pass_id", "target_id"])
    return out.select("pass_id", "target_id", r6("p99", 3).alias("p99"), r6("finite_fraction").alias("finite_fraction"), "scale")


@query(
    "dossier_records",
    """SELECT event_id, basin, CASE WHEN withheld THEN 'detection-only' ELSE concat('q=', cast(floor(q_kg_h) AS bigint)) END AS quant FROM v_runs""",
)
def dossier_records(t: Tables):
    rec = report.dossier(~F.col("withheld"), ["event_id", "basin", "det_date", "result_status", "u10"], ["q_kg_h", "npix"])
    text = F.to_json(rec)
    q = F.get_json_object(text, "$.quant.q_kg_h").cast("double")
    return t.v_runs.select(
        F.get_json_object(text, "$.event_id").alias("event_id"), F.get_json_object(text, "$.basin").alias("basin"),
        F.coalesce(F.concat(F.lit("q="), F.floor(q).cast("string")), F.lit("detection-only")).alias("quant"),
    )
