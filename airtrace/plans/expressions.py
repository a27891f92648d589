"""Queries for the scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, naming, policy, retrieval, screening, solar
from ..operators import calibration
from .registry import Tables, day_text, query, r6
from .sqltext import INTERP, SOLAR_STEPS, hav, mass, mod


def _paired(t: Tables):
    d = t.v_detections.select(F.substring("id", 2, 12).alias("k"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    r = t.v_reference.select(F.substring("id", 2, 12).alias("k"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return d.join(r, "k")


@query(
    "haversine_km",
    f"""SELECT substr(d.id, 2) AS k, round({hav('d.lon', 'd.lat', 'r.lon', 'r.lat')}, 6) AS km
        FROM v_detections d JOIN v_reference r ON substr(d.id, 2) = substr(r.id, 2)""",
)
def haversine(t: Tables):
    return _paired(t).select("k", r6(geo.haversine_km("x1", "y1", "x2", "y2")).alias("km"))


_GRID = dict(lon0=58.0, lat0=40.0, dlon=0.05, dlat=-0.04)


@query(
    "grid_to_lonlat",
    """SELECT scene_id, row, col, round(58.0 + col * 0.05, 6) AS lon, round(40.0 - row * 0.04, 6) AS lat
       FROM v_scene""",
)
def grid_to_lonlat(t: Tables):
    lon, lat = geo.grid_to_lonlat("row", "col", **_GRID)
    return t.v_scene.select("scene_id", "row", "col", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query(
    "lonlat_to_grid",
    """SELECT id, cast(round_even((lat - 40.0) / -0.04, 0) AS int) AS row,
              cast(round_even((lon - 58.0) / 0.05, 0) AS int) AS col
       FROM (SELECT id, lon + 0.003 AS lon, lat + 0.003 AS lat FROM v_detections)""",
)
def lonlat_to_grid(t: Tables):
    row, col = geo.lonlat_to_grid(F.col("lon") + 0.003, F.col("lat") + 0.003, **_GRID)
    return t.v_detections.select("id", row.alias("row"), col.alias("col"))


@query(
    "km_per_degree",
    """SELECT id, round(6371.0088 * cos(radians(lat)) * pi() / 180, 6) AS lon_km,
              round(6371.0088 * pi() / 180, 6) AS lat_km FROM v_detections""",
)
def km_per_degree(t: Tables):
    x, y = geo.km_per_degree("lat")
    return t.v_detections.select("id", r6(x).alias("lon_km"), r6(y).alias("lat_km"))


@query(
    "qa_filter",
    """SELECT stack_id, frame, count(*) AS n, count(CASE WHEN qa >= 0.5 AND value IS NOT NULL
              AND (frame % 10) / 20.0 <= 0.3 AND row <> 3 THEN 1 END) AS n_pass
       FROM v_pixels GROUP BY 1, 2""",
)
def qa_filter(t: Tables):
    ok = screening.qa_pass("qa", "value", (F.col("frame") % 10) / 20.0, extra=[F.col("row") != 3])
    return t.v_pixels.groupBy("stack_id", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_pass")
    )


_ZSQL = """m AS (SELECT scene_id, quantile_cont(value, 0.5) AS median FROM v_scene GROUP BY 1),
 d AS (SELECT s.scene_id, quantile_cont(abs(value - median), 0.5) / 250 AS mad
       FROM v_scene s JOIN m USING (scene_id) GROUP BY 1),
 z AS (SELECT s.scene_id, s.row, s.col, CASE WHEN mad >= 2 THEN 0.6745 * (value - median) / mad / 250 END AS z
       FROM v_scene s JOIN m USING (scene_id) JOIN d USING (scene_id))"""


def _scene_z(t: Tables):
    med = t.v_scene.groupBy("scene_id").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    dev = t.v_scene.join(med, "scene_id")
    mad = dev.groupBy("scene_id").agg(
        (F.percentile(F.abs(F.col("value") - F.col("median")), F.lit(0.5)) / 250).alias("mad")
    )
    z = screening.modified_z("value", "median", "mad") / 250
    return dev.join(mad, "scene_id").select("scene_id", "row", "col", z.alias("z"))


@query("modified_z", "SELECT scene_id, row, col, round(z, 6) AS z FROM z", extra=_ZSQL)
def modified_z(t: Tables):
    return _scene_z(t).select("scene_id", "row", "col", r6("z").alias("z"))


@query(
    "threshold_mask",
    "SELECT scene_id, count(*) AS n, count(CASE WHEN z >= 0.007 THEN 1 END) AS n_over FROM z GROUP BY 1",
    extra=_ZSQL,
)
def threshold_mask(t: Tables):
    return _scene_z(t).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(screening.exceeds("z", 0.007), 1)).alias("n_over")
    )


@query(
    "log_band_ratio",
    """SELECT target_id, pass_id, row, col, CASE WHEN y <> 0 AND x / y > 0 THEN round(ln(x / y), 6) END AS u
       FROM (SELECT *, b11 - 2e4 AS x, b12 - 2e4 AS y FROM v_bands)""",
)
def log_band_ratio(t: Tables):
    u = retrieval.log_band_ratio(F.col("b11") - 2e4, F.col("b12") - 2e4)
    return t.v_bands.select("target_id", "pass_id", "row", "col", r6(u).alias("u"))


@query(
    "dn_validity",
    """SELECT target_id, pass_id, row, col, nodata, negative, NOT nodata AND NOT negative AS valid,
              CASE WHEN NOT nodata AND NOT negative THEN round(dn, 6) ELSE 0 END AS dn,
              CASE WHEN NOT nodata AND NOT negative THEN round(dn, 6) END AS dn_or_null
       FROM (SELECT *, refl IS NULL AS nodata, coalesce(dn <= 0, false) AS negative
             FROM (SELECT *, refl * 1e4 - 1000 AS dn
                   FROM (SELECT *, CASE WHEN valid THEN b11 / 4e5 END AS refl FROM v_bands)))""",
)
def dn_validity(t: Tables):
    parts = retrieval.digital_number(F.when(F.col("valid"), F.col("b11") / 4e5), -1000.0)
    return t.v_bands.select(
        "target_id", "pass_id", "row", "col", parts["nodata"].alias("nodata"), parts["negative"].alias("negative"),
        parts["valid"].alias("valid"), r6(parts["dn"]).alias("dn"), r6(parts["dn_or_null"]).alias("dn_or_null"),
    )


_ENTRY = """concat('<RADIO_ADD_OFFSET band_id="', {b}, '">-', cast({v} AS varchar(9)), '</RADIO_ADD_OFFSET>')"""


@query(
    "band_offset",
    """SELECT o_orderkey AS scene_key, CASE o_orderkey % 4 WHEN 0 THEN -1.0 * (o_orderkey % 900)
              WHEN 1 THEN -1.0 * (o_custkey % 700) ELSE 0.0 END AS off FROM orders""",
)
def band_offset(t: Tables):
    xml = F.concat(
        F.expr(_ENTRY.format(b="'11'", v="o_orderkey % 900")), F.expr(_ENTRY.format(b="'12'", v="o_custkey % 700"))
    )
    band = F.element_at(F.array(*[F.lit(b) for b in ("B11", "B12", "B10", "B8A")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("scene_key"), naming.band_offset(xml, band).alias("off"))


@query(
    "scene_name_parse",
    r"""SELECT pass_key, split_part(scene, '_', 1) AS platform,
               CASE WHEN regexp_matches(scene, '_R\d{3}_') THEN regexp_extract(scene, '_(R\d{3})_', 1) ELSE 'R???' END AS orbit,
               CASE WHEN scene LIKE '%T101031%' THEN strftime(strptime(regexp_extract(scene, '(\d{8}T\d{6})', 1), '%Y%m%dT%H%M%S'),
                    '%Y-%m-%d %H:%M:%S') END AS acquired
        FROM v_passes""",
)
def scene_name_parse(t: Tables):
    return t.v_passes.select(
        "pass_key", naming.platform("scene").alias("platform"), naming.relative_orbit("scene").alias("orbit"),
        F.date_format(naming.acquisition_time("scene"), "yyyy-MM-dd HH:mm:ss").alias("acquired"),
    )


NOISE_KEY = """concat(CASE WHEN run_key % 23 = 0 THEN '' ELSE basin END, '_',
  CASE WHEN run_key % 29 = 0 THEN 'nodate' ELSE cast(det_date AS varchar(10)) END,
  CASE run_key % 3 WHEN 0 THEN '_cloudscreened' WHEN 1 THEN '_unscreened' ELSE '' END,
  CASE WHEN run_key % 2 = 0 THEN concat('_', cast(run_key % 60 AS varchar(3)), 'd') ELSE '' END,
  CASE WHEN run_key % 5 = 0 THEN '_v2_x' ELSE '' END)"""


@query(
    "noise_key_parse",
    """SELECT run_key, ok, CASE WHEN ok THEN basin END AS basin, CASE WHEN ok THEN cast(det_date AS varchar) END AS day,
              CASE WHEN NOT ok THEN '' WHEN run_key % 3 = 0 THEN 'true' WHEN run_key % 3 = 1 THEN 'false' ELSE '' END AS screened,
              CASE WHEN ok AND run_key % 2 = 0 THEN run_key % 60 ELSE -1 END AS baseline,
              CASE WHEN ok AND run_key % 5 = 0 THEN 'v2,x' ELSE '' END AS extra
       FROM (SELECT *, run_key % 23 <> 0 AND run_key % 29 <> 0 AS ok FROM v_runs)""",
)
def noise_key_parse(t: Tables):
    k = naming.noise_key(F.col("key"))
    ok = k["ok"]
    return t.v_runs.withColumn("key", F.expr(NOISE_KEY)).select(
        F.col("run_key"), ok.alias("ok"), F.when(ok, k["basin"]).alias("basin"), F.when(ok, day_text(k["day"])).alias("day"),
        F.coalesce(F.when(ok, k["cloud_screened"].cast("string")), F.lit("")).alias("screened"),
        F.coalesce(F.when(ok, k["baseline_days"]), F.lit(-1)).cast("long").alias("baseline"),
        F.coalesce(F.when(ok, F.concat_ws(",", k["extra"])), F.lit("")).alias("extra"),
    )


_D = "(date_diff('day', DATE '1970-01-01', date) + sec / 86400.0 + (2440587.5 - 2451545.0))"
SOLAR = f"""sun AS (SELECT event_key, lat, lon, {_D} AS n FROM (SELECT *, (event_key % 1440) * 60.0 AS sec FROM v_basin_events)),""" + SOLAR_STEPS


@query(
    "solar_zenith",
    "SELECT event_key, round(degrees(acos(least(1, greatest(-1, upward)))), 4) AS sza FROM sky",
    extra=SOLAR,
)
def solar_zenith(t: Tables):
    seconds = F.unix_date("date") * 86400.0 + (F.col("event_key") % 1440) * 60.0
    return t.v_basin_events.select("event_key", r6(solar.solar_zenith_deg(seconds, "lat", "lon"), 4).alias("sza"))


@query(
    "nominal_overpass",
    """SELECT event_key, round(date_diff('day', DATE '1970-01-01', date) * 86400.0 + (10.5 - lon / 15) * 3600, 3) AS utc_seconds
       FROM v_basin_events""",
)
def nominal_overpass(t: Tables):
    return t.v_basin_events.select("event_key", r6(solar.nominal_overpass_seconds("date", "lon"), 3).alias("utc_seconds"))


def band_pairs(t: Tables):
    """Target pixels next to every reference pass, both as log ratios."""
    b = t.v_bands.select("target_id", "pass_id", "row", "col", retrieval.log_band_ratio("b11", "b12").alias("u"))
    target = b.where("pass_id = 0").select("target_id", "row", "col", F.col("u").alias("ut"))
    return b.where("pass_id > 0").join(target, ["target_id", "row", "col"])


@query(
    "enhancement_alpha",
    """SELECT r.target_id, r.pass_id, r.row, r.col, round((ln(t.b11 / t.b12) - ln(r.b11 / r.b12)) / (1.2e-4 - 3e-5), 4) AS ppb
       FROM v_bands r JOIN v_bands t ON t.target_id = r.target_id AND t.row = r.row AND t.col = r.col
       WHERE t.pass_id = 0 AND r.pass_id > 0""",
)
def enhancement_alpha(t: Tables):
    ppb = retrieval.linear_enhancement("ut", "u", 3e-5, 1.2e-4)
    return band_pairs(t).select("target_id", "pass_id", "row", "col", r6(ppb, 4).alias("ppb"))


_CAL = "cal AS (SELECT * FROM v_calibration), scenes AS (SELECT * FROM v_geometry)," + INTERP


@query(
    "calibration_interp",
    "SELECT scene_key, round(c1, 4) AS c1, round(c2, 4) AS c2, round(c3, 4) AS c3 FROM curve",
    extra=_CAL,
)
def calibration_interp(t: Tables):
    return calibration.attach_curve(t.v_geometry, t.v_calibration).select(
        "scene_key", r6("c1", 4).alias("c1"), r6("c2", 4).alias("c2"), r6("c3", 4).alias("c3")
    )


@query(
    "ppb_from_log_ratio",
    """SELECT scene_key, round(sign(log_ratio) * (c1 * abs(log_ratio) + c2 * pow(abs(log_ratio), 2) + c3 * pow(abs(log_ratio), 3)), 4) AS ppb,
              round(1e6 / c1, 6) AS d_alpha_e6 FROM curve""",
    extra=_CAL,
)
def ppb_from_log_ratio(t: Tables):
    curve = calibration.attach_curve(t.v_geometry, t.v_calibration)
    return curve.select(
        "scene_key", r6(retrieval.cubic_ppb("log_ratio", "c1", "c2", "c3"), 4).alias("ppb"),
        r6(1e6 / F.col("c1")).alias("d_alpha_e6"),
    )


_RTM = """cal AS (SELECT * FROM v_calibration),
 scenes AS (SELECT DISTINCT target_id AS scene_key, 'S2A' AS satellite, 20e0 + target_id % 50 AS sza,
            (target_id % 12) * 1e0 AS vza, 0e0 AS log_ratio FROM v_bands),""" + INTERP


@query(
    "enhancement_rtm",
    """SELECT p.target_id, p.pass_id, p.row, p.col,
         round(sign(x) * (c1 * abs(x) + c2 * pow(abs(x), 2) + c3 * pow(abs(x), 3)), 3) AS ppb
       FROM (SELECT r.target_id, r.pass_id, r.row, r.col, ln(t.b11 / t.b12) - ln(r.b11 / r.b12) AS x
             FROM v_bands r JOIN v_bands t ON t.target_id = r.target_id AND t.row = r.row AND t.col = r.col
             WHERE t.pass_id = 0 AND r.pass_id > 0) p JOIN curve ON curve.scene_key = p.target_id""",
    extra=_RTM,
)
def enhancement_rtm(t: Tables):
    scenes = t.v_bands.select("target_id").distinct().select(
        "target_id", F.lit("S2A").alias("satellite"), (F.lit(20.0) + F.col("target_id") % 50).alias("sza"),
        (F.col("target_id") % 12).cast("double").alias("vza"),
    )
    curves = calibration.attach_curve(scenes, t.v_calibration).select("target_id", "c1", "c2", "c3")
    return calibration.rtm_enhancement(band_pairs(t).join(curves, "target_id"), "ut", "u").select(
        "target_id", "pass_id", "row", "col", r6("ppb", 3).alias("ppb")
    )


@query(
    "simplified_slope",
    "SELECT satellite, sza, vza, round(c1 / (1 / (1.2e-4 - 3e-5)), 6) AS understatement FROM v_calibration",
)
def simplified_slope(t: Tables):
    return t.v_calibration.select(
        "satellite", "sza", "vza", r6(F.col("c1") / retrieval.simplified_slope(3e-5, 1.2e-4)).alias("understatement")
    )


@query(
    "column_mass",
    f"""SELECT scene_id, row, col, round({mass('value')} * 1e3, 6) AS g_m2,
               round({mass('value', '950.0')} * 1e3, 6) AS g_m2_950 FROM v_scene""",
)
def column_mass(t: Tables):
    return t.v_scene.select(
        "scene_id", "row", "col", r6(retrieval.column_mass("value") * 1e3).alias("g_m2"),
        r6(retrieval.column_mass("value", 950.0) * 1e3).alias("g_m2_950"),
    )


@query(
    "column_mass_alt",
    """SELECT scene_id, row, col, round(value * (8.0 * (1e-6 * 1000.0 / 22.4 * 0.01604)) * 1e6, 6) AS mg_m2 FROM v_scene""",
)
def column_mass_alt(t: Tables):
    return t.v_scene.select("scene_id", "row", "col", r6(retrieval.column_mass_alt("value") * 1e6).alias("mg_m2"))


@query("effective_wind", "SELECT event_id, round(0.33 * speed + 0.45, 6) AS ueff FROM v_winds")
def effective_wind(t: Tables):
    return t.v_winds.select("event_id", r6(retrieval.effective_wind("speed")).alias("ueff"))


@query(
    "source_rate",
    """SELECT event_id, round(sqrt(npix * 400.0), 6) AS length_m,
              round(q_kg_h / 1e2 * (0.33 * u10 + 0.45) * 3600 / sqrt(npix * 400.0), 3) AS rate FROM v_runs""",
)
def source_rate(t: Tables):
    length = retrieval.plume_length("npix", 400.0)
    rate = retrieval.source_rate(F.col("q_kg_h") / 1e2, retrieval.effective_wind("u10"), length)
    return t.v_runs.select("event_id", r6(length).alias("length_m"), r6(rate, 3).alias("rate"))


@query(
    "wind_derive",
    f"""SELECT event_id, round(sqrt(u * u + v * v), 6) AS speed, round({mod('degrees(atan2(-u, -v))', '360')}, 4) AS dir_from,
               round({mod('270 - degrees(atan2(-v, -u))', '360')}, 4) AS dir_legacy
        FROM (SELECT event_id, 1.5 + event_id % 7 AS u, event_id % 11 - 5.25 AS v FROM v_winds)""",
)
def wind_derive(t: Tables):
    w = t.v_winds.select("event_id", (1.5 + F.col("event_id") % 7).alias("u"), (F.col("event_id") % 11 - 5.25).alias("v"))
    return w.select(
        "event_id", r6(retrieval.wind_speed("u", "v")).alias("speed"),
        r6(retrieval.wind_from_direction("u", "v"), 4).alias("dir_from"),
        r6(retrieval.wind_from_direction("u", "v", legacy=True), 4).alias("dir_legacy"),
    )


@query("gate_limit_scale", "SELECT satellite, sza, vza, round(7.2e-3 * c1, 6) AS limit_ppb FROM v_calibration")
def gate_limit_scale(t: Tables):
    return t.v_calibration.select("satellite", "sza", "vza", r6(retrieval.gate_limit("c1", 7.2e-3)).alias("limit_ppb"))


@query(
    "flux_identity",
    """SELECT event_id, round(3600 * (0.33 * u10 + 0.45) * (8.0 * (1e-6 * 1000.0 / 22.4 * 0.01604)) * (q_kg_h / 1e3)
              * sqrt(npix * 400.0), 4) AS q FROM v_runs""",
)
def flux_identity(t: Tables):
    q = retrieval.flux_identity(F.col("q_kg_h") / 1e3, "npix", 400.0, retrieval.effective_wind("u10"))
    return t.v_runs.select("event_id", r6(q, 4).alias("q"))


@query(
    "downwind_unit",
    """SELECT event_id, CASE WHEN s > 0 THEN round(-v / s, 6) END AS d_row, CASE WHEN s > 0 THEN round(u / s, 6) END AS d_col
       FROM (SELECT *, sqrt(u * u + v * v) AS s FROM (SELECT event_id, event_id % 7 - 3e0 AS u, event_id % 11 - 5e0 AS v FROM v_winds))""",
)
def downwind_unit(t: Tables):
    w = t.v_winds.select("event_id", (F.col("event_id") % 7 - 3.0).alias("u"), (F.col("event_id") % 11 - 5.0).alias("v"))
    d_row, d_col = retrieval.downwind_unit("u", "v")
    return w.select("event_id", r6(d_row).alias("d_row"), r6(d_col).alias("d_col"))


@query(
    "cue_decision",
    """SELECT o_orderkey AS k, CASE WHEN n >= 4 OR z >= 5 THEN 'cue_sentinel2' ELSE 'watch' END AS action,
         CASE WHEN n >= 4 THEN concat('persistent source (', n, ' passes)')
              WHEN z >= 5 THEN concat('transient ultra-emission (z=', printf('%.1f', z), ' >= 5.0)')
              ELSE concat('weak transient (z=', printf('%.1f', z), ' < 5.0)') END AS reason,
         CASE WHEN n < 4 THEN concat('persistence: ', n, ' < 4: not promoted to primary')
              ELSE 'no_revisit_info: cue archive search anyway' END AS what_if
       FROM (SELECT o_orderkey, o_orderkey % 7 AS n, (o_orderkey % 80) / 10e0 AS z FROM orders)""",
)
def cue_decision(t: Tables):
    d = policy.cue_decision(F.col("o_orderkey") % 7, (F.col("o_orderkey") % 80) / 10.0)
    m = d["counterfactuals"]
    return t.orders.select(
        F.col("o_orderkey").alias("k"), d["action"].alias("action"), d["reason"].alias("reason"),
        F.concat_ws(": ", F.map_keys(m)[0], F.map_values(m)[0]).alias("what_if"),
    )


@query(
    "status_classify",
    """SELECT event_id, CASE WHEN NOT readable THEN 'unreadable' WHEN superseded AND do_not_quote THEN 'withdrawn'
         WHEN result_status = 'diagnostic' OR superseded AND result_status = 'F' THEN 'diagnostic'
         WHEN superseded OR do_not_quote THEN 'withdrawn' ELSE 'quotable' END AS status FROM v_runs""",
)
def status_classify(t: Tables):
    from ..operators.report import classify_runs

    runs = t.v_runs
    withdrawn = runs.where("superseded AND do_not_quote").select("event_id")
    diagnostic = runs.where("superseded AND result_status = 'F'").select("event_id")
    return classify_runs(runs, withdrawn, diagnostic).select("event_id", "status")


@query(
    "public_tier",
    """SELECT id, round(round(lon / 0.01) * 0.01, 4) AS lon, round(round(lat / 0.01) * 0.01, 4) AS lat,
              cast(date AS varchar) AS day FROM (SELECT id, date, lon + 0.0031 AS lon, lat + 0.0072 AS lat FROM v_basin_events)
       WHERE date <= DATE '2025-08-01' - 30""",
)
def public_tier(t: Tables):
    ev = t.v_basin_events.where(policy.old_enough("date", F.lit("2025-08-01").cast("date")))
    return ev.select(
        "id", r6(policy.coarsen(F.col("lon") + 0.0031), 4).alias("lon"),
        r6(policy.coarsen(F.col("lat") + 0.0072), 4).alias("lat"), day_text("date").alias("day"),
    )


@query(
    "branch_assign",
    """SELECT user_id, n, CASE WHEN n >= 30 THEN 'full' WHEN n >= 15 THEN 'intermediate' ELSE 'descriptive' END AS branch
       FROM (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1)""",
)
def branch_assign(t: Tables):
    n = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "n", policy.power_branch("n").alias("branch"))


@query(
    "scene_event_key",
    "SELECT overpass_key, concat('CR-', campaign, '-', strftime(date, '%Y%m%d')) AS event_id FROM v_truth",
)
def scene_event_key(t: Tables):
    return t.v_truth.select("overpass_key", naming.release_event_id("campaign", "date").alias("event_id"))


@query(
    "core_threshold",
    """SELECT scene_id, count(CASE WHEN in_mask THEN 1 END) AS n_mask,
              count(CASE WHEN plume_score > 0.9 THEN 1 END) AS n_core FROM v_scene GROUP BY 1""",
)
def core_threshold(t: Tables):
    return t.v_scene.groupBy("scene_id").agg(
        F.count(F.when(F.col("in_mask"), 1)).alias("n_mask"),
        F.count(F.when(screening.over("plume_score", 0.9), 1)).alias("n_core"),
    )


@query(
    "angle_fallback",
    """SELECT scene_key, CASE scene_key % 4 WHEN 0 THEN sza WHEN 1 THEN 90 - sza ELSE 35 END AS sza,
              CASE WHEN scene_key % 4 = 3 THEN 5 WHEN scene_key % 2 = 0 THEN vza ELSE 10 END AS vza FROM v_geometry""",
)
def angle_fallback(t: Tables):
    k = F.col("scene_key") % 4
    props = F.when(
        k != 3,
        F.to_json(F.struct(
            F.when(k == 0, F.col("sza")).alias("sza"), F.when(k == 1, F.col("sza")).alias("sun_elevation"),
            F.when(F.col("scene_key") % 2 == 0, F.col("vza")).alias("vza"),
        )),
    )
    g = t.v_geometry.withColumn("props", props)
    sza, vza = solar.view_angles("props", F.col("props").isNotNull())
    return g.select("scene_key", sza.alias("sza"), vza.alias("vza"))
