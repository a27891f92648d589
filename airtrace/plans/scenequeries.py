"""Queries for scene selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenes
from .registry import Tables, query, r6

_SCORED = """sp AS (SELECT event, pass_key, scene, dt_days, cloud, corr, mbsp,
    CASE WHEN abs(dt_days) < 2 THEN 'inside 2d exclusion zone' WHEN abs(dt_days) > 12 THEN 'outside +/-window' WHEN cloud > 0.05 THEN printf('cloud %.2f > 0.05', cloud::double)
         WHEN corr < 0.95 THEN printf('surface corr %.3f < 0.95', corr::double) WHEN mbsp > 3.0 THEN printf('own plume %.1fsigma', mbsp::double) END AS why,
    round(0.5 * (1 - cloud) + 0.3 * corr + 0.2 * greatest(1 - abs(dt_days) / 10.0, 0), 5) AS s FROM v_passes)"""


@query(
    "reference_pass_select",
    """SELECT event, arg_max(scene, (s, -pass_key)) FILTER (why IS NULL) AS chosen, max(s) FILTER (why IS NULL) AS score,
              count(why) AS n_rejected FROM sp GROUP BY 1""",
    extra=_SCORED,
)
def reference_pass_select(t: Tables):
    return scenes.select_reference_pass(t.v_passes.withColumn("pass_id", F.col("scene")), "pass_key")


@query("reference_pass_verdicts", "SELECT pass_key, coalesce(why, '') AS why, CASE WHEN why IS NULL THEN s END AS score FROM sp", extra=_SCORED)
def reference_pass_verdicts(t: Tables):
    return scenes.score_passes(t.v_passes).select("pass_key", F.coalesce("rejected_reason", F.lit("")).alias("why"), "score")


_COVER = """cover AS (SELECT event, dt_days, arg_min(scene, (nodata > 0.02, CASE WHEN nodata <= 0.02 THEN 0 ELSE nodata END, pass_key)) AS scene,
   min(nodata) <= 0.02 AS covered FROM v_passes GROUP BY 1, 2)"""


@query("pick_covering", "SELECT event, dt_days, scene, covered FROM cover", extra=_COVER)
def pick_covering(t: Tables):
    return scenes.pick_covering(t.v_passes, ["event", "dt_days"], "pass_key").select("event", "dt_days", "scene", "covered")


_TARGET = _COVER + """, target AS (SELECT event, arg_min(dt_days, (abs(dt_days), dt_days)) AS t_day, arg_min(scene, (abs(dt_days), dt_days)) AS t_scene
   FROM cover WHERE covered AND dt_days BETWEEN -16 AND 8 GROUP BY 1)"""


@query("target_scene_pick", "SELECT event, t_day AS dt_days, t_scene AS scene FROM target", extra=_TARGET)
def target_scene_pick(t: Tables):
    return scenes.target_scene_pick(t.v_passes, "pass_key").select("event", "dt_days", "scene")


_ORBIT = r"coalesce(nullif(regexp_extract({s}, '_(R\d{{3}})_', 1), ''), 'R???')"
_PAIRS = _TARGET + f""", pool AS (SELECT p.*, {_ORBIT.format(s='p.scene')} = {_ORBIT.format(s='t.t_scene')} AS same FROM v_passes p JOIN target t ON t.event = p.event
   WHERE t.t_day - p.dt_days BETWEEN 3 AND 21 AND split_part(p.scene, '_', 1) = split_part(t.t_scene, '_', 1)),
 daily AS (SELECT event, same, dt_days, arg_min(scene, pass_key) AS scene FROM pool WHERE nodata <= 0.02 GROUP BY 1, 2, 3),
 s AS (SELECT * FROM daily WHERE same QUALIFY row_number() OVER (PARTITION BY event ORDER BY dt_days DESC) <= 3),
 c AS (SELECT d.* FROM daily d WHERE NOT same AND NOT EXISTS (SELECT 1 FROM s WHERE s.event = d.event AND s.dt_days = d.dt_days)
   QUALIFY row_number() OVER (PARTITION BY d.event ORDER BY d.dt_days DESC) <= 3 - (SELECT count(*) FROM s WHERE s.event = d.event))"""


@query(
    "pair_references",
    "SELECT event, dt_days, scene, same AS same_orbit, row_number() OVER (PARTITION BY event ORDER BY dt_days DESC) AS rank FROM (SELECT * FROM s UNION ALL SELECT * FROM c)",
    extra=_PAIRS,
)
def pair_references(t: Tables):
    targets = scenes.target_scene_pick(t.v_passes, "pass_key")
    out = scenes.pair_references(targets, t.v_passes, "pass_key")
    return out.select("event", "dt_days", "scene", "same_orbit", F.col("rank").cast("long").alias("rank"))


@query(
    "background_lag_search",
    """SELECT event, arg_min(scene, o) AS scene, arg_min(lag, o) AS lag_days, arg_min(cloud, o) AS cloud FROM (
         SELECT d.*, p.cloud, (p.cloud > 0.05, CASE WHEN p.cloud <= 0.05 THEN 0 ELSE p.cloud END, 2 * abs(lag) - CASE WHEN lag > 0 THEN 1 ELSE 0 END) AS o FROM (
           SELECT p.event, t.t_day - p.dt_days AS lag, arg_min(p.scene, p.pass_key) AS scene FROM v_passes p JOIN target t ON t.event = p.event
           WHERE nodata <= 0.02 AND t.t_day <> p.dt_days AND (t.t_day - p.dt_days) % 10 = 0 AND abs(t.t_day - p.dt_days) <= 70
             AND p.dt_days NOT BETWEEN 14 AND 15 AND split_part(p.scene, '_', 1) = split_part(t.t_scene, '_', 1) GROUP BY 1, 2) d
         JOIN v_passes p ON p.event = d.event AND p.scene = d.scene) GROUP BY 1""",
    extra=_TARGET,
)
def background_lag_search(t: Tables):
    targets = scenes.target_scene_pick(t.v_passes, "pass_key")
    return scenes.background_lag_search(targets, t.v_passes, "pass_key", excluded=(14, 15)).select(
        "event", "scene", "lag_days", "cloud"
    )


@query(
    "pick_pair",
    """SELECT t.event, t.t AS target, arg_min(p.scene, (d - dt_days, p.pass_key)) AS reference, min(d - dt_days) AS lag_days FROM (
         SELECT event, arg_min(scene, (abs(dt_days), dt_days, pass_key)) AS t, arg_min(dt_days, (abs(dt_days), dt_days, pass_key)) AS d
         FROM v_passes WHERE dt_days BETWEEN -1 AND 4 GROUP BY 1) t JOIN v_passes p ON p.event = t.event AND t.d - p.dt_days BETWEEN 4 AND 16 GROUP BY 1, 2""",
)
def pick_pair(t: Tables):
    return scenes.pick_pair(t.v_passes, "pass_key")


@query(
    "window_coverage",
    """SELECT scene_id, count(CASE WHEN valid THEN 1 END) AS n_finite, round(1 - count(CASE WHEN valid THEN 1 END) / 256, 6) AS nodata_fraction FROM v_scene GROUP BY 1""",
)
def window_coverage(t: Tables):
    px = t.v_scene.withColumn("value", F.when(F.col("valid"), F.col("value")))
    return scenes.window_coverage(px, ["scene_id"], F.lit(256)).withColumn("nodata_fraction", r6("nodata_fraction"))


@query(
    "cloud_fraction",
    """SELECT target_id, pass_id, round(avg(CASE WHEN cast(b12 / 1e3 AS int) % 5 IN (1, 2, 3) THEN 1.0 ELSE 0 END), 6) AS cloud_fraction,
              count(CASE WHEN cast(b12 / 1e3 AS int) % 5 NOT IN (1, 2, 3) THEN 1 END) AS n_clear FROM v_bands GROUP BY 1, 2""",
)
def cloud_fraction(t: Tables):
    px = t.v_bands.withColumn("cloud_class", (F.col("b12") / 1e3).cast("int") % 5)
    return scenes.cloud_fraction(px, ["target_id", "pass_id"]).withColumn("cloud_fraction", r6("cloud_fraction"))


@query(
    "reference_pass_stats",
    """SELECT target_id, pass_id, round(corr(b12, m12), 6) AS surface_corr, round(max(abs(u - mu)) / any_value(s), 4) AS mbsp_abs_sigma FROM (
         SELECT *, quantile_cont(b12, 0.5) OVER (PARTITION BY target_id, row, col) AS m12, quantile_cont(u, 0.5) OVER (PARTITION BY target_id, row, col) AS mu,
                1.4826 * mad(u) OVER (PARTITION BY target_id, pass_id) AS s FROM (SELECT *, ln(b11 / b12) AS u FROM v_bands)) GROUP BY 1, 2""",
)
def reference_pass_stats(t: Tables):
    from ..functions.retrieval import log_band_ratio
    from ..operators.retrieve import log_ratio_noise

    b = t.v_bands.withColumn("u", log_band_ratio("b11", "b12"))
    noise = log_ratio_noise(b, ["target_id", "pass_id"], "u").select("target_id", "pass_id", F.col("robust_sigma").alias("sigma"))
    out = scenes.reference_pass_stats(b, ["target_id"], noise)
    return out.select("target_id", "pass_id", r6("surface_corr").alias("surface_corr"), r6("mbsp_abs_sigma", 4).alias("mbsp_abs_sigma"))
