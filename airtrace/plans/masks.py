"""Queries for masks: stencils, components, delineation, registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, components, delineate, stencil
from .registry import Tables, query, r6
from .sqltext import component_ctes

KEY = ["scene_id"]
_MASK = "m AS MATERIALIZED (SELECT scene_id AS s, row AS r, col AS c FROM v_scene WHERE in_mask),"


def _mask(t: Tables):
    return t.v_scene.where("in_mask").select("scene_id", "row", "col")


def _shape(t: Tables):
    return t.v_scene.select("scene_id").distinct().withColumn("n_rows", F.lit(16)).withColumn("n_cols", F.lit(16))


def _order_free(df):
    return df.select("scene_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


@query(
    "extract_blobs",
    """SELECT s AS scene_id, label, count(*) AS n_pixels, round(max(value), 6) AS peak_value, round(sum(value), 4) AS value_sum,
         round(CASE WHEN sum(greatest(value, 0)) > 0 THEN sum(lab.r * greatest(value, 0)) / sum(greatest(value, 0)) ELSE avg(lab.r) END, 6) AS row,
         round(CASE WHEN sum(greatest(value, 0)) > 0 THEN sum(lab.c * greatest(value, 0)) / sum(greatest(value, 0)) ELSE avg(lab.c) END, 6) AS col,
         min(lab.r) AS r0, max(lab.r) + 1 AS r1, min(lab.c) AS c0, max(lab.c) + 1 AS c1
       FROM lab JOIN v_scene v ON v.scene_id = s AND v.row = lab.r AND v.col = lab.c GROUP BY 1, 2 HAVING count(*) >= 3""",
    recursive=True, extra=_MASK + component_ctes("m"),
)
def extract_blobs(t: Tables):
    b = components.extract_blobs(t.v_scene, KEY)
    return b.select(
        "scene_id", "label", "n_pixels", r6("peak_value").alias("peak_value"), r6(F.col("mean_value") * F.col("n_pixels"), 4).alias("value_sum"),
        r6("row").alias("row"), r6("col").alias("col"), "bbox.r0", "bbox.r1", "bbox.c0", "bbox.c1",
    )


@query(
    "rank_output",
    """SELECT scene_id, r, n_pixels FROM (SELECT s AS scene_id, count(*) AS n_pixels, row_number() OVER (PARTITION BY s ORDER BY max(value) DESC, label) AS r
       FROM lab JOIN v_scene v ON v.scene_id = s AND v.row = lab.r AND v.col = lab.c GROUP BY s, label HAVING count(*) >= 3)""",
    recursive=True, extra=_MASK + component_ctes("m"),
)
def rank_output(t: Tables):
    from ..operators.ranking import row_numbers

    b = components.extract_blobs(t.v_scene, KEY)
    ranked = row_numbers(b.drop("bbox", "row", "col"), [F.col("peak_value").desc(), F.col("label")], "r", KEY)
    return ranked.select("scene_id", "r", "n_pixels")


_SOURCE = """src AS (SELECT DISTINCT scene_id AS s, (scene_id * 5) % 16 + 4e-1 AS y, (scene_id * 11) % 16 + 3e-1 AS x FROM v_scene),"""


def _sources(t: Tables):
    return t.v_scene.select("scene_id").distinct().select(
        "scene_id", ((F.col("scene_id") * 5) % 16 + 0.4).alias("src_row"), ((F.col("scene_id") * 11) % 16 + 0.3).alias("src_col"),
        F.lit(16).alias("n_rows"), F.lit(16).alias("n_cols"),
        F.when(F.col("scene_id") % 5 != 0, 1.0 + F.col("scene_id") % 3).alias("u"),
        F.when(F.col("scene_id") % 5 != 0, F.col("scene_id") % 4 - 2.0).alias("v"),
    )


@query(
    "source_component",
    """SELECT l.s AS scene_id, l.r AS row, l.c AS col, round(pick.off, 4) AS offset_m FROM lab l JOIN (
         SELECT s, coalesce(max(CASE WHEN r = round_even(y, 0) AND c = round_even(x, 0) THEN label END), arg_min(label, (pow(r - y, 2) + pow(c - x, 2), r, c))) AS label,
                CASE WHEN max(CASE WHEN r = round_even(y, 0) AND c = round_even(x, 0) THEN label END) IS NULL THEN sqrt(min(pow(r - y, 2) + pow(c - x, 2))) * 20 ELSE 0 END AS off
         FROM lab JOIN src USING (s) GROUP BY 1) pick ON pick.s = l.s AND pick.label = l.label""",
    recursive=True, extra=_MASK + _SOURCE + component_ctes("m", eight=True),
)
def source_component(t: Tables):
    kept, chosen = components.source_component(_mask(t), _sources(t), KEY)
    return _order_free(kept).join(chosen.select("scene_id", r6("offset_m", 4).alias("offset_m")), "scene_id")


@query(
    "drop_small_components",
    "SELECT s AS scene_id, r AS row, c AS col FROM (SELECT *, count(*) OVER (PARTITION BY s, label) AS n FROM lab) WHERE n >= 4",
    recursive=True, extra=_MASK + component_ctes("m", eight=True),
)
def drop_small_components(t: Tables):
    return _order_free(components.drop_small(components.pixel_components(_mask(t), KEY, eight=True), KEY, 4))


@query(
    "fill_small_holes",
    """SELECT s AS scene_id, r AS row, c AS col FROM m UNION ALL
       SELECT l.s, l.r, l.c FROM lab l JOIN (SELECT s, label FROM lab JOIN bx USING (s) GROUP BY 1, 2
         HAVING count(*) <= 3 AND NOT bool_or(r < r0 OR r > r1 OR c < c0 OR c > c1)) h ON h.s = l.s AND h.label = l.label""",
    recursive=True,
    extra=_MASK + """bx AS (SELECT s, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM m GROUP BY 1),
      bg AS MATERIALIZED (SELECT s, r, c FROM bx, (SELECT unnest(range(-1, 17)) AS r), (SELECT unnest(range(-1, 17)) AS c)
         WHERE r BETWEEN r0 - 1 AND r1 + 1 AND c BETWEEN c0 - 1 AND c1 + 1 AND (s, r, c) NOT IN (SELECT (s, r, c) FROM m)),"""
    + component_ctes("bg"),
)
def fill_small_holes(t: Tables):
    return _order_free(components.fill_holes(_mask(t), KEY, 3))


_NEIGHBOURS = "g AS (SELECT unnest([-1, 0, 1]) AS d),"


@query(
    "binary_open",
    """SELECT DISTINCT e.s AS scene_id, e.r + a.d AS row, e.c + b.d AS col FROM (
         SELECT m.s, m.r + a.d AS r, m.c + b.d AS c FROM m, g a, g b GROUP BY 1, 2, 3 HAVING count(*) = 9) e, g a, g b""",
    extra=_NEIGHBOURS + "m AS (SELECT scene_id AS s, row AS r, col AS c FROM v_scene WHERE value > -5e2)",
)
def binary_open(t: Tables):
    m = t.v_scene.where("value > -5e2").select("scene_id", "row", "col")
    return _order_free(stencil.binary_open(m, KEY))


@query(
    "binary_close",
    """SELECT s AS scene_id, r AS row, c AS col FROM (SELECT d.s, d.r + a.d AS r, d.c + b.d AS c FROM
         (SELECT DISTINCT m.s, m.r + a.d AS r, m.c + b.d AS c FROM m, g a, g b) d, g a, g b GROUP BY 1, 2, 3 HAVING count(*) = 9)""",
    extra=_NEIGHBOURS + _MASK.rstrip(","),
)
def binary_close(t: Tables):
    return _order_free(stencil.binary_close(_mask(t), KEY))


@query(
    "plume_mask",
    """SELECT p.scene_id, p.r AS row, p.c AS col FROM (SELECT x.scene_id, rr AS r, cc AS c, count(raw.row) AS n FROM
          (SELECT q.scene_id, rr, cc, least(greatest(rr + a.d, 0), 15) AS r, least(greatest(cc + b.d, 0), 15) AS c
           FROM (SELECT DISTINCT scene_id FROM v_scene) q, (SELECT unnest(range(16)) AS rr), (SELECT unnest(range(16)) AS cc), g a, g b) x
          LEFT JOIN raw ON raw.scene_id = x.scene_id AND raw.row = x.r AND raw.col = x.c GROUP BY 1, 2, 3) p
       JOIN v_scene v ON v.scene_id = p.scene_id AND v.row = p.r AND v.col = p.c WHERE p.n >= 5""",
    extra=_NEIGHBOURS + """sm AS (SELECT scene_id, quantile_cont(value, 0.5) AS m FROM v_scene GROUP BY 1),
      sd AS (SELECT scene_id, greatest(1.4826 * quantile_cont(abs(value - m), 0.5), 2.0) AS sg FROM v_scene JOIN sm USING (scene_id) GROUP BY 1),
      raw AS (SELECT v.scene_id, v.row, v.col FROM v_scene v JOIN sd USING (scene_id) WHERE value >= 0.5 * sg)""",
)
def plume_mask(t: Tables):
    return _order_free(stencil.plume_mask(t.v_scene, _shape(t), KEY, k=0.5))


@query(
    "tile_windows",
    """SELECT scene_id, r0, c0, count(*) AS n, round(max(value), 6) AS peak FROM v_scene, (SELECT unnest(range(0, 9, 4)) AS r0), (SELECT unnest(range(0, 9, 4)) AS c0)
       WHERE row BETWEEN r0 AND r0 + 7 AND col BETWEEN c0 AND c0 + 7 GROUP BY 1, 2, 3""",
)
def tile_windows(t: Tables):
    tiles = stencil.tile_windows(t.v_scene, _shape(t), KEY, 8, 4)
    return tiles.groupBy("scene_id", "r0", "c0").agg(F.count(F.lit(1)).alias("n"), r6(F.max("value")).alias("peak"))


@query(
    "downwind_sector",
    """SELECT scene_id, row, col FROM (SELECT v.scene_id, row, col, (row - y) * 20 AS a, (col - x) * 20 AS b, -v / sqrt(u * u + v * v) AS dr, u / sqrt(u * u + v * v) AS dc
         FROM v_scene v JOIN w ON w.s = v.scene_id) WHERE a * dr + b * dc + 100 >= 0 AND abs(a * dc - b * dr) <= tan(radians(60)) * (a * dr + b * dc + 100)""",
    extra=_SOURCE + "w AS (SELECT *, 1e0 + s % 3 AS u, s % 4 - 2e0 AS v FROM src WHERE s % 5 <> 0)",
)
def downwind_sector(t: Tables):
    px = t.v_scene.select("scene_id", "row", "col").join(_sources(t), "scene_id")
    return px.where(delineate.in_sector()).select("scene_id", "row", "col")


@query(
    "distance_bound",
    """SELECT scene_id, row, col FROM v_scene v JOIN w ON w.s = v.scene_id WHERE sqrt(pow(row - y, 2) + pow(col - x, 2)) * 20 <= greatest(sqrt(u * u + v * v) * 60, 40)""",
    extra=_SOURCE + "w AS (SELECT *, 1e0 + s % 3 AS u, s % 4 - 2e0 AS v FROM src WHERE s % 5 <> 0)",
)
def distance_bound(t: Tables):
    px = t.v_scene.select("scene_id", "row", "col").join(_sources(t), "scene_id")
    return px.where(delineate.within_extent(delineate.extent_m(seconds=60.0))).select("scene_id", "row", "col")


@query(
    "amplitude_rule",
    "SELECT scene_id, count(*) AS n FROM v_scene WHERE in_mask AND value > 0 AND value <= 900 GROUP BY 1",
)
def amplitude_rule(t: Tables):
    return t.v_scene.where(F.col("in_mask") & delineate.plausible("value", 0.5)).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


def _erode(src: str) -> str:
    return f"SELECT x.s, x.r + a.d AS r, x.c + b.d AS c FROM {src} x, g a, g b GROUP BY 1, 2, 3 HAVING count(*) = 9"


def _dilate(src: str) -> str:
    return f"SELECT DISTINCT x.s, x.r + a.d AS r, x.c + b.d AS c FROM {src} x, g a, g b"


def _kept(mask: str, tag: str) -> str:
    """Pixels of the component at, or nearest to, the source."""
    return f"""SELECT l.s, l.r, l.c FROM {tag}lab l JOIN (
      SELECT s, coalesce(max(CASE WHEN r = round_even(y, 0) AND c = round_even(x, 0) THEN label END), arg_min(label, (pow(r - y, 2) + pow(c - x, 2), r, c))) AS label
      FROM {tag}lab JOIN w USING (s) GROUP BY 1) p ON p.s = l.s AND p.label = l.label"""


_CHAIN = (
    _NEIGHBOURS + _SOURCE + """w AS (SELECT *, CASE WHEN s % 5 <> 0 THEN 1e0 + s % 3 END AS u, CASE WHEN s % 5 <> 0 THEN s % 4 - 2e0 END AS v FROM src),
 m0 AS MATERIALIZED (SELECT scene_id AS s, row AS r, col AS c, valid, value FROM v_scene WHERE value > -5e2),
 m1 AS MATERIALIZED (SELECT * FROM m0 WHERE valid), m2 AS MATERIALIZED (SELECT * FROM m1 WHERE value <= 1080 AND value > -4e2),
 er AS MATERIALIZED (""" + _erode("m2") + "), m3 AS MATERIALIZED (" + _dilate("er") + "), dl AS MATERIALIZED (" + _dilate("m3")
    + "), m4 AS MATERIALIZED (SELECT * FROM (" + _erode("dl") + ") WHERE r BETWEEN 0 AND 15 AND c BETWEEN 0 AND 15),"
    + """ bx AS (SELECT s, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM m4 GROUP BY 1),
 bg AS MATERIALIZED (SELECT s, r, c FROM bx, (SELECT unnest(range(-1, 17)) AS r), (SELECT unnest(range(-1, 17)) AS c)
    WHERE r BETWEEN r0 - 1 AND r1 + 1 AND c BETWEEN c0 - 1 AND c1 + 1 AND (s, r, c) NOT IN (SELECT (s, r, c) FROM m4)),"""
    + component_ctes("bg", "f_") + """,
 m5 AS MATERIALIZED (SELECT s, r, c FROM m4 UNION ALL SELECT l.s, l.r, l.c FROM f_lab l JOIN (SELECT s, label FROM f_lab JOIN bx USING (s) GROUP BY 1, 2
    HAVING count(*) <= 25 AND NOT bool_or(r < r0 OR r > r1 OR c < c0 OR c > c1)) h ON h.s = l.s AND h.label = l.label),"""
    + component_ctes("m5", "g_", True) + ", m6 AS MATERIALIZED (SELECT s, r, c FROM g_lab QUALIFY count(*) OVER (PARTITION BY s, label) >= 4),"
    + component_ctes("m6", "h_", True) + ", m7 AS MATERIALIZED (" + _kept("m6", "h_") + """),
 m8 AS MATERIALIZED (SELECT m7.s, r, c FROM m7 JOIN w USING (s) WHERE u IS NULL OR
    ((r - y) * 20 * -v / sqrt(u * u + v * v) + (c - x) * 20 * u / sqrt(u * u + v * v) + 100 >= 0 AND abs((r - y) * 20 * u / sqrt(u * u + v * v) - (c - x) * 20 * -v / sqrt(u * u + v * v))
       <= tan(radians(60)) * ((r - y) * 20 * -v / sqrt(u * u + v * v) + (c - x) * 20 * u / sqrt(u * u + v * v) + 100))),
 m9 AS MATERIALIZED (SELECT m8.s, r, c FROM m8 JOIN w USING (s) WHERE sqrt(pow(r - y, 2) + pow(c - x, 2)) * 20 <= 200),"""
    + component_ctes("m9", "k_", True) + ", m10 AS MATERIALIZED (" + _kept("m9", "k_") + ")"
)
_RULE_NAMES = ["invalid", "amplitude", "morphology_open", "morphology_close", "morphology_fill", "morphology_min_size",
               "source_connectivity", "downwind_sector", "distance_bound", "reconnect"]


@query(
    "delineate_plume",
    """SELECT scene_id, rule, b AS n_before, a AS n_after, greatest(b - a, 0) AS dropped_px, greatest(a - b, 0) AS added_px,
        CASE WHEN skip IS NULL THEN 'applied' ELSE 'skipped' END AS status,
        coalesce(skip, CASE WHEN rule = 'source_connectivity' AND far > 0 THEN
          'source pixel is not inside the candidate mask; kept the nearest component, ' || round(far)::bigint || ' m away' END) AS note
       FROM (SELECT x.*, off.far, CASE WHEN rule = 'source_connectivity' AND b = 0 THEN 'mask already empty'
          WHEN rule = 'downwind_sector' AND u IS NULL THEN 'needs both a source position and a wind vector'
          WHEN rule = 'reconnect' AND b = 0 THEN 'mask empty after geometric clipping' END AS skip
       FROM w, (SELECT s, CASE WHEN bool_or(r = round_even(y, 0) AND c = round_even(x, 0)) THEN 0 ELSE sqrt(min(pow(r - y, 2) + pow(c - x, 2))) * 20 END AS far
          FROM w LEFT JOIN m6 USING (s) GROUP BY 1) off, ("""
    + " UNION ALL ".join(
        f"""SELECT q.scene_id, '{n}' AS rule, (SELECT count(*) FROM m{i} WHERE s = q.scene_id) AS b, (SELECT count(*) FROM m{i + 1} WHERE s = q.scene_id) AS a
            FROM (SELECT DISTINCT scene_id FROM v_scene) q"""
        for i, n in enumerate(_RULE_NAMES)
    ) + ") x WHERE w.s = x.scene_id AND off.s = x.scene_id)",
    recursive=True, extra=_CHAIN,
)
def delineate_plume(t: Tables):
    px = t.v_scene.withColumn("in_mask", F.col("value") > -5e2)
    _, ledger = delineate.delineate_plume(px, _sources(t), KEY, max_ratio=0.6, min_ppb=-4e2, max_extent=200.0)
    return ledger.select("scene_id", "rule", "n_before", "n_after", "dropped_px", "added_px", "status", "note")


@query(
    "delineation_skips",
    """SELECT scene_id, rule, b AS n_before, a AS n_after, CASE WHEN note IS NULL THEN 'applied' ELSE 'skipped' END AS status, note FROM (
         SELECT s AS scene_id, rule, ns[i + 1] AS b, ns[j + 1] AS a, CASE WHEN rule LIKE 'morphology%' OR rule = 'source_connectivity' THEN 'disabled by caller'
           WHEN rule = 'downwind_sector' AND (y IS NULL OR u IS NULL) THEN 'needs both a source position and a wind vector'
           WHEN rule = 'distance_bound' AND (y IS NULL OR u IS NULL) THEN 'needs a source position and either max_extent_m or a wind speed' END AS note
         FROM n, (VALUES ('amplitude', 0, 1), ('morphology_open', 1, 1), ('morphology_close', 1, 1), ('morphology_fill', 1, 1), ('morphology_min_size', 1, 1),
           ('source_connectivity', 1, 1), ('downwind_sector', 1, 2), ('distance_bound', 2, 3)) k(rule, i, j))""",
    extra=_SOURCE + """w AS (SELECT s, CASE WHEN s % 3 > 0 THEN y END AS y, x, CASE WHEN s % 5 > 0 THEN 1e0 + s % 3 END AS u, s % 4 - 2e0 AS v FROM src),
      p AS (SELECT w.*, row, col, value > 0 AND value <= 3600 AS ok,
         coalesce(((row - y) * 20 * -v / sqrt(u * u + v * v) + (col - x) * 20 * u / sqrt(u * u + v * v) + 100 >= 0 AND abs((row - y) * 20 * u / sqrt(u * u + v * v) - (col - x) * 20 * -v / sqrt(u * u + v * v))
           <= tan(radians(60)) * ((row - y) * 20 * -v / sqrt(u * u + v * v) + (col - x) * 20 * u / sqrt(u * u + v * v) + 100)), true) AS cone,
         u IS NULL OR coalesce(sqrt(pow(row - y, 2) + pow(col - x, 2)) * 20 <= greatest(sqrt(u * u + v * v) * 900, 40), true) AS near FROM v_scene JOIN w ON w.s = scene_id WHERE value > -5e2),
      n AS (SELECT w.s, w.y, w.u, [count(p.s), count(CASE WHEN ok THEN 1 END), count(CASE WHEN ok AND cone THEN 1 END), count(CASE WHEN ok AND cone AND near THEN 1 END)] AS ns
         FROM w LEFT JOIN p ON p.s = w.s GROUP BY 1, 2, 3)""",
)
def delineation_skips(t: Tables):
    px = t.v_scene.select("scene_id", "row", "col", "value", (F.col("value") > -5e2).alias("in_mask"))
    s = F.col("scene_id")
    lost = _sources(t).withColumn("src_row", F.when(s % 3 > 0, F.col("src_row")))
    _, ledger = delineate.delineate_plume(px, lost, KEY, disabled=frozenset({"morphology", "source_connectivity"}))
    return ledger.select("scene_id", "rule", "n_before", "n_after", "status", "note")


_LEDGER = """led AS (SELECT scene_id, 0 AS ord, 'invalid' AS rule, count(CASE WHEN in_mask THEN 1 END) AS b, count(CASE WHEN in_mask AND valid THEN 1 END) AS a FROM v_scene GROUP BY 1
   UNION ALL SELECT scene_id, 1, 'amplitude', count(CASE WHEN in_mask AND valid THEN 1 END), count(CASE WHEN in_mask AND valid AND value > 0 THEN 1 END) FROM v_scene GROUP BY 1
   UNION ALL SELECT scene_id, 2, 'morphology_close', count(CASE WHEN in_mask AND valid AND value > 0 THEN 1 END), count(CASE WHEN valid AND value > -1e2 AND in_mask THEN 1 END) FROM v_scene GROUP BY 1)"""


def _given_ledger(t: Tables):
    both, pos = F.col("in_mask") & F.col("valid"), F.col("value") > 0
    g = t.v_scene.groupBy("scene_id").agg(
        F.count_if("in_mask").alias("n0"), F.count_if(both).alias("n1"), F.count_if(both & pos).alias("n2"),
        F.count_if(both & (F.col("value") > -1e2)).alias("n3"),
    )
    steps = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(r).alias("rule"), F.col(f"n{i}").alias("n_before"), F.col(f"n{i + 1}").alias("n_after"))
        for i, r in enumerate(["invalid", "amplitude", "morphology_close"])
    ])
    return g.select("scene_id", F.explode(steps).alias("s")).select(
        "scene_id", "s.*", F.lit("applied").alias("status"),
        F.greatest(F.col("s.n_before") - F.col("s.n_after"), F.lit(0)).alias("dropped_px"),
        F.greatest(F.col("s.n_after") - F.col("s.n_before"), F.lit(0)).alias("added_px"),
    )


@query(
    "delineation_report",
    """SELECT scene_id, arg_min(b, ord) AS n_input_px, arg_max(a, ord) AS n_kept_px, sum(greatest(b - a, 0))::bigint AS n_dropped_px, sum(greatest(a - b, 0))::bigint AS n_added_px,
         CASE WHEN max(b - a) > 0 THEN arg_max(rule, (greatest(b - a, 0), -ord)) END AS dominant_rule,
         round(arg_min(b, ord) * 400 / 1e6, 6) AS area_km2_before, round(CASE WHEN arg_max(a, ord) = 0 THEN 0 ELSE sqrt(arg_max(a, ord) / arg_min(b, ord)) END, 6) AS implied_flux_factor, true AS balanced
       FROM led GROUP BY 1""",
    extra=_LEDGER,
)
def delineation_report(t: Tables):
    rep = delineate.delineation_report(_given_ledger(t), KEY)
    return rep.select(
        "scene_id", "n_input_px", "n_kept_px", "n_dropped_px", "n_added_px", "dominant_rule",
        r6("area_km2_before").alias("area_km2_before"), r6("implied_flux_factor").alias("implied_flux_factor"), "balanced",
    )


@query(
    "delineation_report_means",
    """SELECT scene_id, round(mb, 6) AS mean_before, round(ma, 6) AS mean_after, round(b / nullif(a, 0), 6) AS area_shrink_factor,
         round(CASE WHEN b = 0 THEN NULL WHEN a = 0 THEN 0 WHEN mb IS NULL OR ma IS NULL OR mb = 0 THEN sqrt(a / b) ELSE ma / mb * sqrt(a / b) END, 6) AS implied_flux_factor
       FROM (SELECT scene_id, arg_min(b, ord) AS b, arg_max(a, ord) AS a FROM led GROUP BY 1)
       JOIN (SELECT scene_id, avg(CASE WHEN in_mask THEN value END) AS mb, avg(CASE WHEN in_mask AND valid AND value > -1e2 THEN value END) AS ma FROM v_scene GROUP BY 1) USING (scene_id)""",
    extra=_LEDGER,
)
def delineation_report_means(t: Tables):
    """The implied change of the rate with the mean of the field before and after."""
    kept = F.col("in_mask") & F.col("valid") & (F.col("value") > -1e2)
    means = t.v_scene.groupBy("scene_id").agg(F.avg(F.when(F.col("in_mask"), F.col("value"))).alias("mean_before"), F.avg(F.when(kept, F.col("value"))).alias("mean_after"))
    rep = delineate.delineation_report(_given_ledger(t), KEY, means)
    return rep.select("scene_id", *[r6(c).alias(c) for c in ("mean_before", "mean_after", "area_shrink_factor", "implied_flux_factor")])


@query(
    "delineation_rule_shares",
    "SELECT scene_id, rule, round(greatest(b - a, 0) / first_value(b) OVER (PARTITION BY scene_id ORDER BY ord), 6) AS share FROM led",
    extra=_LEDGER,
)
def delineation_rule_shares(t: Tables):
    return delineate.rule_shares(_given_ledger(t), KEY).select("scene_id", "rule", r6("dropped_frac_of_input").alias("share"))


_SURFACE = """moved AS (SELECT r.target_id, r.pass_id, dy, dx, corr(r.b11, t.b11) AS c FROM v_bands r, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx), v_bands t
     WHERE r.pass_id > 0 AND t.pass_id = 0 AND t.target_id = r.target_id AND t.row = r.row + dy AND t.col = r.col + dx GROUP BY 1, 2, 3, 4),
  pk AS (SELECT target_id, pass_id, arg_max(dy, o) AS dy, arg_max(dx, o) AS dx, arg_max(c, o) AS c FROM (SELECT *, (round(c, 9), -(abs(dy) + abs(dx)), -dy, -dx) AS o FROM moved) GROUP BY 1, 2),
  nb AS (SELECT p.target_id, p.pass_id, p.dy, p.dx, p.c, max(CASE WHEN m.dy = p.dy - 1 AND m.dx = p.dx THEN m.c END) AS n, max(CASE WHEN m.dy = p.dy + 1 AND m.dx = p.dx THEN m.c END) AS s,
     max(CASE WHEN m.dy = p.dy AND m.dx = p.dx - 1 THEN m.c END) AS w, max(CASE WHEN m.dy = p.dy AND m.dx = p.dx + 1 THEN m.c END) AS e FROM pk p JOIN moved m USING (target_id, pass_id) GROUP BY ALL)"""


@query(
    "align_shift",
    """SELECT target_id, pass_id, round(dy + coalesce(CASE WHEN n - 2 * c + s < 0 THEN 0.5 * (n - s) / (n - 2 * c + s) END, 0), 2) AS dy,
              round(dx + coalesce(CASE WHEN w - 2 * c + e < 0 THEN 0.5 * (w - e) / (w - 2 * c + e) END, 0), 2) AS dx, round(c, 6) AS peak FROM nb""",
    extra=_SURFACE,
)
def align_shift(t: Tables):
    b = t.v_bands.select("target_id", "pass_id", "row", "col", F.col("b11").alias("value"))
    out = align.align_shift(b.where("pass_id = 0"), b.where("pass_id > 0"), ["target_id"], ["pass_id"], 2)
    return out.select("target_id", "pass_id", "dy", "dx", r6("peak").alias("peak"))


@query(
    "resample_shift",
    """SELECT scene_id, row, col, CASE WHEN count(*) = count(v.value) THEN round(sum(wt * v.value), 6) END AS value FROM (
         SELECT scene_id, row, col, cast(least(greatest(floor(y) + a, 0), 15) AS int) AS sr, cast(least(greatest(floor(x) + b, 0), 15) AS int) AS sc,
                (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS wt
         FROM (SELECT scene_id, row, col, row - CASE WHEN scene_id % 4 = 0 THEN 0 ELSE 0.7 END AS y, col - CASE WHEN scene_id % 4 = 0 THEN 0 ELSE -1.3 END AS x FROM v_scene),
              (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) k LEFT JOIN (SELECT scene_id AS s, row AS r, col AS c, value FROM v_scene) v ON v.s = scene_id AND v.r = sr AND v.c = sc
       WHERE wt > 0 GROUP BY 1, 2, 3""",
)
def resample_shift(t: Tables):
    small = F.col("scene_id") % 4 == 0
    shifts = t.v_scene.select("scene_id").distinct().select(
        "scene_id", F.when(small, 0.04).otherwise(0.7).alias("dy"), F.when(small, 0.01).otherwise(-1.3).alias("dx")
    )
    px = t.v_scene.select("scene_id", "row", "col", "value")
    return align.resample_shift(px, shifts, _shape(t), KEY).select("scene_id", "row", "col", r6("value").alias("value"))
