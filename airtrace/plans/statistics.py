"""Queries for agreement statistics and other aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import pick
from ..operators import calibration, evaluate, matching, retrieve, stencil
from .registry import Tables, query, r6
from .sqltext import bootstrap_sql, cluster_ctes, match_ctes


@query(
    "precision_recall",
    """SELECT n_matched, round(n_matched / n_det, 6) AS precision, round(n_matched / n_ref, 6) AS recall,
              round(2.0 * n_matched / (n_det + n_ref), 6) AS f1
       FROM (SELECT (SELECT count(*) FROM matches) AS n_matched, (SELECT count(*) FROM v_detections) AS n_det,
                    (SELECT count(*) FROM v_reference) AS n_ref)""",
    recursive=True, extra=match_ctes(),
)
def precision_recall(t: Tables):
    m = matching.match_events(t.v_detections, t.v_reference).agg(F.count(F.lit(1)).alias("n_matched"))
    nd = t.v_detections.agg(F.count(F.lit(1)).alias("nd"))
    nr = t.v_reference.agg(F.count(F.lit(1)).alias("nr"))
    p, r, f1 = evaluate.precision_recall(F.col("n_matched"), F.col("nd"), F.col("nr"))
    return m.crossJoin(nd).crossJoin(nr).select(
        "n_matched", r6(p).alias("precision"), r6(r).alias("recall"), r6(f1).alias("f1")
    )


@query(
    "roc_curve",
    """SELECT n_chars::double AS threshold, round(sum(t) OVER w / (SELECT sum(t) FROM s), 6) AS tpr, round(sum(f) OVER w / (SELECT sum(f) FROM s), 6) AS fpr
       FROM s WINDOW w AS (ORDER BY n_chars DESC)""",
    extra="""s AS (SELECT n_chars, count(CASE WHEN quality = 1 THEN 1 END) AS t, count(CASE WHEN quality = 0 THEN 1 END) AS f
             FROM documents JOIN labels USING (doc_id) GROUP BY 1)""",
)
def roc_curve(t: Tables):
    scored = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(
        F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("is_true")
    )
    return evaluate.roc_curve(scored).select("threshold", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


_CLUSTERS = {
    "precision": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "recall": "CASE WHEN o_totalprice > 15e4 THEN 1 ELSE 0 END",
}


def _register_bootstrap(which: str, hit: str):
    ctes = f"k AS (SELECT o_custkey AS cluster, count(*) AS n, sum({hit}) AS tp FROM orders GROUP BY 1)"

    @query(
        f"cluster_bootstrap_{which}",
        f"SELECT round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ({bootstrap_sql('k', 2000)})",
        extra=ctes,
    )
    def build(t: Tables):
        k = t.orders.groupBy(F.col("o_custkey").alias("cluster")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.expr(hit)).alias("tp")
        )
        return evaluate.cluster_bootstrap(k).select(r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))

    return build


for _name, _hit in _CLUSTERS.items():
    _register_bootstrap(_name, _hit)


_BOTH = ", ".join(
    f"k_{n} AS (SELECT o_custkey AS cluster, count(*) AS n, sum({h}) AS tp FROM orders GROUP BY 1)" for n, h in _CLUSTERS.items()
)


@query(
    "cluster_bootstrap",
    " UNION ALL ".join(
        f"SELECT '{n}' AS stat, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ({bootstrap_sql(f'k_{n}', 2000)})" for n in _CLUSTERS
    ),
    extra=_BOTH,
)
def cluster_bootstrap(t: Tables):
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.expr(h).alias("hit")) for n, h in _CLUSTERS.items()])).alias("x")
    k = t.orders.select(F.col("o_custkey").alias("cluster"), parts).groupBy("x.stat", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x.hit").alias("tp")
    )
    return evaluate.cluster_bootstrap(k, group=["stat"]).select("stat", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


_GRID = [(f, w) for f in evaluate.FACTORS for w in evaluate.WINDOWS]
_STRICT = "strictref AS (SELECT * FROM v_reference WHERE status <> 'P'),"
_STUDY = (
    "lenientref AS (SELECT * FROM v_reference)," + _STRICT
    + match_ctes("strictref", tag="s_") + "," + match_ctes("lenientref", tag="l_") + ","
    + cluster_ctes("v_detections", 25, 14, "d_") + "," + cluster_ctes("strictref", 25, 14, "a_") + ","
    + cluster_ctes("lenientref", 25, 14, "b_")
    + "".join("," + cluster_ctes(f"{m}ref", 25 * f, w, f"{m}{i}_") for m in ("strict", "lenient") for i, (f, w) in enumerate(_GRID))
    + "".join(
        f", {m}_grid AS (" + " UNION ALL ".join(
            f"SELECT {f} AS cluster_dist_factor, {w} AS cluster_window_days, (SELECT count(DISTINCT anchor) FROM {m}{i}_member) AS n_ref_clusters"
            for i, (f, w) in enumerate(_GRID)
        ) + ")"
        for m in ("strict", "lenient")
    )
    + "".join(
        f""", {m}_{side} AS (SELECT anchor AS cluster, count(*) AS n, count(x.i) AS tp FROM {member}member m
            LEFT JOIN (SELECT {side}_id AS i FROM {pre}matches) x ON x.i = m.id GROUP BY 1)"""
        for m, pre, det, ref in (("strict", "s_", "d_", "a_"), ("lenient", "l_", "d_", "b_"))
        for side, member in (("det", det), ("ref", ref))
    )
)


def _study_row(mode: str) -> str:
    return f"""SELECT '{mode}' AS mode, r.tp AS n_matched, d.k AS n_det_clusters, r.k AS n_ref_clusters,
      round(r.tp / d.n, 6) AS precision, round(r.tp / r.n, 6) AS recall,
      round(p.ci_low, 6) AS precision_low, round(p.ci_high, 6) AS precision_high, round(q.ci_low, 6) AS recall_low, round(q.ci_high, 6) AS recall_high,
      concat(CASE WHEN r.k >= 30 THEN 'full' WHEN r.k >= 15 THEN 'intermediate' ELSE 'descriptive' END,
        ' (robustness: ', (SELECT count(CASE WHEN n_ref_clusters >= 30 THEN 1 END) FROM {mode}_grid), '/9 combos land in ''full'' branch)') AS branch,
      '{evaluate.DUAL_MODE_SENTENCE}' AS interpretation
      FROM (SELECT sum(n)::bigint AS n, sum(tp)::bigint AS tp, count(*) AS k FROM {mode}_det) d, (SELECT sum(n)::bigint AS n, sum(tp)::bigint AS tp, count(*) AS k FROM {mode}_ref) r,
      ({bootstrap_sql(mode + '_det', 2000)}) p, ({bootstrap_sql(mode + '_ref', 2000)}) q"""


def _modes(t: Tables):
    ref = t.v_reference.select("id", "date", "lon", "lat", "status")
    return ref.withColumn("mode", F.lit("lenient")).unionByName(
        ref.where("status <> 'P'").withColumn("mode", F.lit("strict"))
    )


@query("agreement_study", _study_row("strict") + " UNION ALL " + _study_row("lenient"), recursive=True, extra=_STUDY)
def agreement_study(t: Tables):
    rounded = ["precision", "recall", "precision_low", "precision_high", "recall_low", "recall_high"]
    return evaluate.agreement_study(t.v_detections, _modes(t)).select(
        "mode", "n_matched", "n_det_clusters", "n_ref_clusters", "branch", "interpretation", *[r6(c).alias(c) for c in rounded]
    )


@query(
    "agreement_sensitivity",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS mode, g.*, round((SELECT sum(tp) FROM {m}_det) / (SELECT sum(n) FROM {m}_det), 6) AS precision,
              round((SELECT sum(tp) FROM {m}_ref) / (SELECT sum(n) FROM {m}_ref), 6) AS recall FROM {m}_grid g"""
        for m in ("strict", "lenient")
    ),
    recursive=True, extra=_STUDY,
)
def agreement_sensitivity(t: Tables):
    return evaluate.agreement_sensitivity(t.v_detections, _modes(t)).withColumn("precision", r6("precision")).withColumn("recall", r6("recall"))


@query(
    "strict_lenient_gap",
    """SELECT round((SELECT count(*) FROM l_matches) / nd - (SELECT count(*) FROM s_matches) / nd, 6) AS precision_gap,
              round((SELECT count(*) FROM l_matches) / nl - (SELECT count(*) FROM s_matches) / ns, 6) AS recall_gap
       FROM (SELECT (SELECT count(*) FROM v_detections) AS nd, (SELECT count(*) FROM lenientref) AS nl, (SELECT count(*) FROM strictref) AS ns)""",
    recursive=True,
    extra="lenientref AS (SELECT * FROM v_reference)," + _STRICT + match_ctes("strictref", tag="s_") + "," + match_ctes("lenientref", tag="l_"),
)
def strict_lenient_gap(t: Tables):
    ref = t.v_reference.select("id", "date", "lon", "lat", "status")
    modes = ref.withColumn("mode", F.lit("lenient")).unionByName(
        ref.where("status <> 'P'").withColumn("mode", F.lit("strict"))
    )
    det = t.v_detections.select("id", "date", "lon", "lat").crossJoin(F.broadcast(modes.select("mode").distinct()))
    tp = matching.match_events(det, modes, equal=["mode"]).groupBy("mode").agg(F.count(F.lit(1)).alias("tp"))
    n = det.groupBy("mode").agg(F.count(F.lit(1)).alias("nd")).join(
        modes.groupBy("mode").agg(F.count(F.lit(1)).alias("nr")), "mode"
    )
    p, r, _ = evaluate.precision_recall(F.col("tp"), F.col("nd"), F.col("nr"))
    gap = evaluate.strict_lenient_gap(n.join(tp, "mode").select("mode", p.alias("precision"), r.alias("recall")))
    return gap.select(r6("precision_gap").alias("precision_gap"), r6("recall_gap").alias("recall_gap"))


@query(
    "sensitivity_grid",
    " UNION ALL ".join(
        f"""SELECT {f} AS cluster_dist_factor, {w} AS cluster_window_days,
              (SELECT count(DISTINCT anchor) FROM g{i}_member) AS n_ref_clusters,
              round((SELECT count(*) FROM matches) / (SELECT count(*) FROM v_detections), 6) AS precision,
              round((SELECT count(*) FROM matches) / (SELECT count(*) FROM v_reference), 6) AS recall"""
        for i, (f, w) in enumerate(_GRID)
    ),
    recursive=True,
    extra=match_ctes() + "," + ",".join(cluster_ctes("v_reference", 25 * f, w, f"g{i}_") for i, (f, w) in enumerate(_GRID)),
)
def sensitivity_grid(t: Tables):
    grid = evaluate.sensitivity_grid(t.v_detections, t.v_reference)
    return grid.withColumn("precision", r6("precision")).withColumn("recall", r6("recall"))


_POWER = """placed AS (SELECT b.basin, b.role, e.id, e.date, e.lon, e.lat FROM v_basin_events e JOIN v_basins b
      ON e.lon BETWEEN b.lon_min AND b.lon_max AND e.lat BETWEEN b.lat_min AND b.lat_max),
  pooled AS (SELECT * FROM placed UNION ALL SELECT 'CHAMPION SET', role, id, date, lon, lat FROM placed WHERE role = 'champion'),
  seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY date, lon, lat) AS k FROM pooled),
  walk(basin, k, anchors, total) AS (
    SELECT DISTINCT basin, 0::bigint, []::struct(d date, lon double, lat double)[], 0::bigint FROM seq
    UNION ALL
    SELECT w.basin, s.k,
      CASE WHEN hit THEN w.anchors ELSE list_append(list_filter(w.anchors, lambda a: date_diff('day', a.d, s.date) <= 14), {'d': s.date, 'lon': s.lon, 'lat': s.lat}) END,
      w.total + CASE WHEN hit THEN 0 ELSE 1 END
    FROM walk w JOIN seq s ON s.basin = w.basin AND s.k = w.k + 1,
      LATERAL (SELECT len(list_filter(w.anchors, lambda a: date_diff('day', a.d, s.date) BETWEEN 0 AND 14
        AND 2 * 6371.0088 * asin(sqrt(pow(sin((radians(s.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(s.lat))
            * pow(sin((radians(s.lon) - radians(a.lon)) / 2), 2))) <= 25)) > 0 AS hit))"""


@query(
    "power_assessment",
    """SELECT p.basin, p.role, p.n AS n_events, w.total AS n_clusters,
              CASE WHEN w.total >= 30 THEN 'full' WHEN w.total >= 15 THEN 'intermediate' ELSE 'descriptive' END AS branch
       FROM (SELECT basin, role, count(*) AS n FROM pooled GROUP BY 1, 2) p JOIN walk w ON w.basin = p.basin AND w.k = p.n""",
    recursive=True, extra=_POWER,
)
def power_assessment(t: Tables):
    return evaluate.power_assessment(t.v_basin_events, t.v_basins)


@query(
    "wind_rose",
    """SELECT site, round(avg(speed), 3) AS mean_speed_ms,
              (SELECT arg_min(s, (-c, s)) * 30.0 + 15 FROM (SELECT cast(floor(direction_from / 30) AS int) % 12 AS s, count(*) AS c
                 FROM v_winds x WHERE x.site = w.site AND month(x.time) = 1 GROUP BY 1)) AS modal_direction_deg, count(*) AS n_samples
       FROM v_winds w WHERE month(time) = 1 GROUP BY site""",
)
def wind_rose(t: Tables):
    return evaluate.wind_rose(t.v_winds, 1)


@query(
    "winds_window_median",
    """SELECT p.pass_id, round(quantile_cont(w.speed, 0.5), 6) AS speed, round(quantile_cont(-w.speed * sin(radians(w.direction_from)), 0.5), 6) AS u10,
              count(*) AS n_hours
       FROM (SELECT o_orderkey AS pass_id, o_custkey // 10 AS site, DATE '2024-01-01' + cast(o_orderkey % 30 AS int) AS date FROM orders) p
       JOIN v_winds w ON w.site = p.site AND date_diff('day', p.date, cast(w.time AS date)) BETWEEN -2 AND 1 GROUP BY 1""",
)
def winds_window_median(t: Tables):
    from ..functions.retrieval import wind_components

    u, v = wind_components("speed", "direction_from")
    passes = t.orders.select(
        F.col("o_orderkey").alias("pass_id"), F.floor(F.col("o_custkey") / 10).alias("site"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("date"),
    )
    out = retrieve.winds_window_median(passes, t.v_winds.withColumn("u10", u).withColumn("v10", v))
    return out.select("pass_id", r6("speed").alias("speed"), r6("u10").alias("u10"), "n_hours")


_SIGMA = """sm AS (SELECT scene_id, quantile_cont(value, 0.5) AS m FROM v_scene GROUP BY 1),
  sd AS (SELECT scene_id, 1.4826 * quantile_cont(abs(value - m), 0.5) AS s FROM v_scene JOIN sm USING (scene_id) GROUP BY 1)"""


@query("robust_sigma", "SELECT scene_id, round(greatest(s, 2.0), 6) AS sigma, round(greatest(s, 900.0), 6) AS floored FROM sd", extra=_SIGMA)
def robust_sigma(t: Tables):
    px = t.v_scene.select("scene_id", "value")
    low = stencil.robust_sigma(px, ["scene_id"], "value", 900.0, "floored")
    return stencil.robust_sigma(px, ["scene_id"], "value").join(low, "scene_id").select(
        "scene_id", r6("sigma").alias("sigma"), r6("floored").alias("floored")
    )


@query(
    "log_ratio_noise",
    """SELECT target_id, pass_id, round(1.4826 * quantile_cont(abs(u - m), 0.5), 6) AS robust_sigma, round(stddev_pop(u), 6) AS plain_std
       FROM (SELECT target_id, pass_id, u, quantile_cont(u, 0.5) OVER (PARTITION BY target_id, pass_id) AS m
             FROM (SELECT target_id, pass_id, ln(b11 / b12) AS u FROM v_bands)) GROUP BY 1, 2""",
)
def log_ratio_noise(t: Tables):
    from ..functions.retrieval import log_band_ratio

    u = t.v_bands.select("target_id", "pass_id", log_band_ratio("b11", "b12").alias("u"))
    return retrieve.log_ratio_noise(u, ["target_id", "pass_id"], "u").select(
        "target_id", "pass_id", r6("robust_sigma").alias("robust_sigma"), r6("plain_std").alias("plain_std")
    )


@query(
    "reference_median",
    """SELECT target_id, row, col, round(quantile_cont(ln(b11 / b12), 0.5), 6) AS u_ref FROM v_bands WHERE pass_id > 0 GROUP BY 1, 2, 3""",
)
def reference_median(t: Tables):
    from ..functions.retrieval import log_band_ratio

    u = t.v_bands.where("pass_id > 0").withColumn("u", log_band_ratio("b11", "b12"))
    return retrieve.reference_median(u, ["target_id", "row", "col"]).select("target_id", "row", "col", r6("u_ref").alias("u_ref"))


@query(
    "cohen_kappa",
    """SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM (
         SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po,
           (SELECT sum(x.c::double * y.c) / pow((SELECT count(*) FROM r), 2) FROM (SELECT a, count(*) AS c FROM r WHERE a IS NOT NULL GROUP BY 1) x
              JOIN (SELECT b, count(*) AS c FROM r WHERE b IS NOT NULL GROUP BY 1) y ON x.a = y.b) AS pe FROM r)""",
    extra="r AS (SELECT CASE WHEN id % 13 <> 0 THEN rater_a END AS a, rater_b AS b FROM v_labels)",
)
def cohen_kappa(t: Tables):
    r = t.v_labels.select(F.when(F.col("id") % 13 != 0, F.col("rater_a")).alias("a"), F.col("rater_b").alias("b"))
    return evaluate.cohen_kappa(r, "a", "b").select("n", r6("po").alias("po"), r6("pe").alias("pe"), r6("kappa").alias("kappa"))


@query(
    "control_hit_rate",
    """SELECT count(*) AS n_controls, round(avg(CASE WHEN pass2 = 'real_plume' THEN 1.0 ELSE 0 END), 6) AS hit_rate,
              avg(CASE WHEN pass2 = 'real_plume' THEN 1.0 ELSE 0 END) < 0.85 AS recalibrate FROM v_labels WHERE is_control""",
)
def control_hit_rate(t: Tables):
    lab = t.v_labels.select("id", F.col("pass2").alias("pass2_final"))
    return evaluate.control_hit_rate(lab, t.v_labels.select("id", "is_control")).withColumn("hit_rate", r6("hit_rate"))


@query(
    "fp_rates",
    """SELECT CASE WHEN grouping(batch) = 1 THEN 'all' ELSE coalesce(cast(batch AS varchar), 'none') END AS batch,
              CASE WHEN grouping(rater) = 1 THEN 'all' ELSE coalesce(rater, 'none') END AS rater, count(*) AS n, round(avg(fp), 6) AS fp_rate
       FROM (SELECT batch, 'a' AS rater, CASE WHEN rater_a = 'artifact' THEN 1.0 ELSE 0 END AS fp FROM v_labels
             UNION ALL SELECT batch, 'adjudicated', CASE WHEN pass2 = 'artifact' THEN 1.0 ELSE 0 END FROM v_labels) GROUP BY CUBE (batch, rater)""",
)
def fp_rates(t: Tables):
    a = t.v_labels.select("batch", F.lit("a").alias("rater"), (F.col("rater_a") == "artifact").alias("is_fp"))
    b = t.v_labels.select("batch", F.lit("adjudicated").alias("rater"), (F.col("pass2") == "artifact").alias("is_fp"))
    return evaluate.fp_rates(a.unionByName(b)).select(
        F.when(F.col("all_batches"), "all").otherwise(F.coalesce(F.col("batch").cast("string"), F.lit("none"))).alias("batch"),
        F.when(F.col("all_raters"), "all").otherwise(F.coalesce("rater", F.lit("none"))).alias("rater"),
        "n", r6("fp_rate").alias("fp_rate"),
    )


_PRED = """pr AS (SELECT o_orderkey % 3 AS seed, (o_orderkey * 37 % 1000) / 1e3 AS p, CASE WHEN o_totalprice > 15e4 THEN 1 ELSE 0 END AS y FROM orders),
  sc AS (SELECT seed, count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp,
                count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn FROM pr GROUP BY 1)"""


def _predictions(t: Tables):
    return t.orders.select(
        (F.col("o_orderkey") % 3).alias("seed"), ((F.col("o_orderkey") * 37 % 1000) / 1e3).alias("p"),
        (F.col("o_totalprice") > 15e4).cast("int").alias("y"),
    )


@query(
    "binary_scores",
    "SELECT seed, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM sc", extra=_PRED,
)
def binary_scores(t: Tables):
    s = evaluate.binary_scores(_predictions(t), ["seed"])
    return s.withColumn("precision", r6("precision")).withColumn("recall", r6("recall"))


@query(
    "seed_spread",
    """SELECT round(avg(tp / (tp + fp)), 6) AS precision_mean, round(stddev_pop(tp / (tp + fp)), 6) AS precision_std,
              round(avg(tp / (tp + fn)), 6) AS recall_mean, round(stddev_pop(tp / (tp + fn)), 6) AS recall_std FROM sc""",
    extra=_PRED,
)
def seed_spread(t: Tables):
    s = evaluate.seed_spread(evaluate.binary_scores(_predictions(t), ["seed"]))
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query(
    "expected_counts",
    """SELECT h.basin, round(clear * hist, 6) AS expected, coalesce(n, 0) AS observed, round(greatest(clear * hist - coalesce(n, 0), 0), 6) AS deficit FROM
        (SELECT basin, count(*) * 0.5 AS hist, avg(CASE WHEN superseded THEN 0.0 ELSE 1 END) AS clear FROM v_runs GROUP BY 1) h LEFT JOIN
        (SELECT basin, count(*) AS n FROM v_runs WHERE is_plume AND withheld GROUP BY 1) d ON d.basin = h.basin""",
)
def expected_counts(t: Tables):
    runs = t.v_runs
    rates = runs.groupBy("basin").agg((F.count(F.lit(1)) * 0.5).alias("historical_rate"))
    clear = runs.groupBy("basin").agg(F.avg((~F.col("superseded")).cast("double")).alias("clear_share"))
    out = evaluate.expected_counts(runs.where("is_plume AND withheld"), rates, clear)
    return out.select("basin", r6("expected").alias("expected"), "observed", r6("deficit").alias("deficit"))


@query(
    "target_rates",
    """SELECT basin, count(*) AS n, round(min(r), 6) AS low, round(quantile_cont(r, 0.5), 6) AS median, round(max(r), 6) AS high FROM (
        SELECT 'metered' AS basin, kg_h / 1000 AS r FROM v_truth WHERE kind = 'release' AND kg_h > 0
        UNION ALL SELECT b.basin, e.rate_t_h FROM v_basin_events e JOIN v_basins b ON e.lon BETWEEN b.lon_min AND b.lon_max
          AND e.lat BETWEEN b.lat_min AND b.lat_max WHERE e.rate_t_h IS NOT NULL) GROUP BY 1""",
)
def target_rates(t: Tables):
    out = evaluate.target_rates(t.v_truth, t.v_basin_events, t.v_basins)
    return out.select("basin", "n", r6("low").alias("low"), r6("median").alias("median"), r6("high").alias("high"))


@query(
    "calibration_fit",
    """SELECT satellite, sza, round(c1, 3) AS c1, round(c2, 3) AS c2, round(c3, 3) AS c3, round(mx, 6) AS max_relative_residual
       FROM fit JOIN (SELECT satellite, sza, max(abs(c1 * x + c2 * x * x + c3 * x * x * x - y) / y) AS mx FROM s JOIN fit USING (satellite, sza)
                      WHERE y > 1 GROUP BY 1, 2) r USING (satellite, sza)""",
    extra="""s AS (SELECT l_suppkey % 2 AS satellite, l_linenumber AS sza, l_quantity / 250 AS x,
               l_quantity / 250 * (3e4 + l_linenumber * 1e3) + pow(l_quantity / 250, 2) * 8e4 + l_discount AS y FROM lineitem),
      m AS (SELECT satellite, sza, sum(x*x) a, sum(x*x*x) b, sum(pow(x,4)) c, sum(pow(x,5)) d, sum(pow(x,6)) e, sum(x*y) u, sum(x*x*y) v, sum(x*x*x*y) w FROM s GROUP BY 1, 2),
      fit AS (SELECT satellite, sza,
        (u*(c*e-d*d) - b*(v*e-d*w) + c*(v*d-c*w)) / (a*(c*e-d*d) - b*(b*e-d*c) + c*(b*d-c*c)) AS c1,
        (a*(v*e-d*w) - u*(b*e-d*c) + c*(b*w-v*c)) / (a*(c*e-d*d) - b*(b*e-d*c) + c*(b*d-c*c)) AS c2,
        (a*(c*w-v*d) - b*(b*w-v*c) + u*(b*d-c*c)) / (a*(c*e-d*d) - b*(b*e-d*c) + c*(b*d-c*c)) AS c3 FROM m)""",
)
def calibration_fit(t: Tables):
    x = F.col("l_quantity") / 250
    s = t.lineitem.select(
        (F.col("l_suppkey") % 2).alias("satellite"), F.col("l_linenumber").alias("sza"), x.alias("x"),
        (x * (3e4 + F.col("l_linenumber") * 1e3) + x * x * 8e4 + F.col("l_discount")).alias("ppb"),
    )
    return calibration.fit_curves(s, ["satellite", "sza"]).select(
        "satellite", "sza", r6("c1", 3).alias("c1"), r6("c2", 3).alias("c2"), r6("c3", 3).alias("c3"),
        r6("max_relative_residual").alias("max_relative_residual"),
    )
