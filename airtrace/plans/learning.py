"""Queries for features, detectors, classifiers and labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.policy import cue_decision
from ..operators import features, labeling
from ..session import shared_dir
from .registry import Tables, query, r6
from .sqltext import component_ctes, tree_ctes

KEY = ["vec_id"]

_PX = """raw AS MATERIALIZED (SELECT vec_id, (pos // 8)::int AS row, (pos % 8)::int AS col, CASE WHEN (vec_id + pos) % 17 <> 0 THEN 1800e0 + 2e2 * x END AS value,
     (vec_id % 5) - 2e0 + pos % 3 AS u10, pos % 4 - 1e0 AS v10, (pos % 10) / 10e0 AS qa, (pos + vec_id) % 6 * 1e0 AS chi2
     FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::double AS x FROM embeddings)),
  px AS MATERIALIZED (SELECT *, CASE WHEN value IS NULL THEN 0 ELSE least(greatest(value - (avg(value) OVER w - stddev_pop(value) OVER w), 0), 100) / 100 END AS norm FROM raw WINDOW w AS (PARTITION BY vec_id)),
  hi AS MATERIALIZED (SELECT vec_id AS s, row AS r, col AS c FROM px WHERE norm > 0.6 AND value IS NOT NULL),""" + component_ctes("hi") + """,
  nv AS (SELECT vec_id AS s, count(value) AS n FROM px GROUP BY 1), nh AS (SELECT s, count(*) AS n FROM hi GROUP BY 1),
  bl AS (SELECT s, label, count(*) AS n, var_samp(r) AS vr, var_samp(c) AS vc, covar_samp(r, c) AS cv FROM lab GROUP BY 1, 2),
  big AS (SELECT * FROM bl QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, label) = 1),
  shape AS (SELECT nv.s, least(coalesce(CASE WHEN nh.n < 3 THEN nh.n ELSE big.n END / nv.n, 0), 1) AS frac,
     CASE WHEN nh.n >= 3 AND big.n >= 3 THEN least(sqrt(greatest((vr + vc) / 2 + sqrt(pow((vr - vc) / 2, 2) + cv * cv), 1e-6) / greatest((vr + vc) / 2 - sqrt(pow((vr - vc) / 2, 2) + cv * cv), 1e-6)), 10) ELSE 1 END AS aspect
     FROM nv LEFT JOIN nh ON nh.s = nv.s LEFT JOIN big ON big.s = nv.s)"""


def packed(t: Tables):
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select(
        "vec_id", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).alias("col"),
        F.when((F.col("vec_id") + F.col("pos")) % 17 != 0, F.col("x").cast("double") * 200.0 + 1800.0).alias("value"),
        (F.col("vec_id") % 5 - 2.0 + F.col("pos") % 3).alias("u10"), (F.col("pos") % 4 - 1.0).alias("v10"),
        ((F.col("pos") % 10) / 10.0).alias("qa_value"), ((F.col("pos") + F.col("vec_id")) % 6 * 1.0).alias("chi2"),
        (F.col("vec_id") % 90 - 45.0).alias("lat"),
    )


_RAW = """SELECT vec_id, count(value) / 64 AS valid_frac, stddev_pop(value) AS xch4_std, max(value) - min(value) AS xch4_ptp,
   max(CASE WHEN value IS NOT NULL THEN norm END) AS norm_max, count(CASE WHEN norm > 0.6 THEN 1 END) / count(value) AS frac_high,
   avg(sqrt(u10 * u10 + v10 * v10)) AS wind_speed_mean, sqrt(pow(avg(u10), 2) + pow(avg(v10), 2)) / avg(sqrt(u10 * u10 + v10 * v10)) AS wind_coherence,
   avg(CASE WHEN value IS NOT NULL THEN chi2 END) AS chi2_mean, min(CASE WHEN value IS NOT NULL THEN qa END) AS qa_min, abs(vec_id % 90 - 45e0) AS abs_lat_center FROM px GROUP BY 1"""
_FEATURES = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in ('valid_frac', 'xch4_std', 'xch4_ptp', 'norm_max', 'frac_high', 'wind_speed_mean', 'wind_coherence', 'chi2_mean', 'qa_min'))}) FROM ({_RAW})"


@query("scene_features", f"SELECT f.*, round(frac, 6) AS blob_frac_largest, round(aspect, 4) AS blob_aspect FROM ({_FEATURES}) f JOIN shape ON shape.s = f.vec_id", recursive=True, extra=_PX)
def scene_features(t: Tables):
    f = features.scene_features(packed(t), KEY, "lat")
    names = [n for n in features.FEATURE_NAMES if n not in ("aot_swir_mean", "albedo_swir_mean", "cloud_frac_mean", "blob_aspect")]
    return f.select("vec_id", *[r6(n).alias(n) for n in names], r6("blob_aspect", 4).alias("blob_aspect"))


@query("blob_shape", "SELECT s AS vec_id, round(frac, 6) AS frac, round(aspect, 4) AS aspect FROM shape", recursive=True, extra=_PX)
def blob_shape(t: Tables):
    f = features.scene_features(packed(t), KEY)
    return f.select("vec_id", r6("blob_frac_largest").alias("frac"), r6("blob_aspect", 4).alias("aspect"))


def _labels(t: Tables):
    return t.embeddings.select("vec_id", F.when(F.col("label") < 4, "plume").otherwise("artifact").alias("label"))


@query(
    "feature_table",
    f"SELECT f.*, round(frac, 6) AS blob_frac_largest, round(aspect, 4) AS blob_aspect, CASE WHEN e.label < 4 THEN 1 ELSE 0 END AS y FROM ({_FEATURES}) f JOIN shape ON shape.s = f.vec_id JOIN embeddings e USING (vec_id)",
    recursive=True, extra=_PX,
)
def feature_table(t: Tables):
    tab = features.feature_table(features.scene_features(packed(t), KEY, "lat"), _labels(t), KEY)
    return tab.select("vec_id", *[r6(n, 4 if n == "blob_aspect" else 6).alias(n) for n in _COLUMNS], "y")


@query(
    "augment_dihedral",
    """SELECT vec_id, CASE k % 4 WHEN 0 THEN r WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r ELSE c END AS row, CASE k % 4 WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 7 - c ELSE 7 - r END AS col, round(value, 6) AS value
       FROM (SELECT vec_id, k, value, CASE WHEN (k // 4) % 2 = 1 THEN 7 - row ELSE row END AS r, CASE WHEN (k // 8) % 2 = 1 THEN 7 - col ELSE col END AS c
         FROM (SELECT *, concat('0x', substr(md5(concat('7-', vec_id, '-3')), 1, 8))::bigint % 16 AS k FROM raw))""",
    recursive=True, extra=_PX,
)
def augment_dihedral(t: Tables):
    return features.augment_dihedral(packed(t), KEY, 8, 7, 3).select("vec_id", "row", "col", r6("value").alias("value"))


@query(
    "train_split",
    """SELECT vec_id, (concat('0x', substr(md5(concat('0-', vec_id)), 1, 8))::bigint + 0.5) / 4294967296.0 < 0.15 AS hashed,
              row_number() OVER (PARTITION BY label ORDER BY md5(concat('0-', vec_id)), vec_id) <= round(count(*) OVER (PARTITION BY label) * 0.15) AS stratified FROM embeddings""",
)
def train_split(t: Tables):
    e = t.embeddings.select("vec_id", "label")
    a = features.hash_split(e, "vec_id", 0).select("vec_id", F.col("is_holdout").alias("hashed"))
    b = features.stratified_split(e, "vec_id", "label", 0).select("vec_id", F.col("is_holdout").alias("stratified"))
    return a.join(b, "vec_id")


def _add(x: str, y: str, n: int) -> str:
    return f"list_transform(range(1, {n + 1}), lambda i: {x}[i] + {y}[i])"


def solve_ctes(tag: str, system: str, key: str, n: int) -> str:
    """``{tag}sol`` (key, z): the solutions of the symmetric systems in ``system`` (key, mat, rhs) by conjugate gradients."""
    return f"""{tag}cg({key}, k, z, r, p, rs) AS (
   SELECT {key}, 0, list_transform(rhs, lambda v: 0e0), rhs, rhs, list_dot_product(rhs, rhs) FROM {system}
   UNION ALL SELECT {key}, k + 1, z, r, list_transform(range(1, {n + 1}), lambda i: r[i] + rs2 / rs * p[i]), rs2 FROM (
     SELECT {key}, k, z, r, p, rs, list_dot_product(r, r) AS rs2 FROM (
       SELECT {key}, k, list_transform(range(1, {n + 1}), lambda i: z[i] + rs / pap * p[i]) AS z, list_transform(range(1, {n + 1}), lambda i: r[i] - rs / pap * ap[i]) AS r, p, rs FROM (
         SELECT {key}, k, z, r, p, rs, ap, list_dot_product(p, ap) AS pap FROM (
           SELECT c.*, list_transform(s.mat, lambda row: list_dot_product(row, c.p)) AS ap FROM {tag}cg c JOIN {system} s USING ({key}) WHERE c.k < 400 AND c.rs > 1e-26)))) ),
 {tag}sol AS MATERIALIZED (SELECT {key}, arg_max(z, k) AS z FROM {tag}cg GROUP BY ALL)"""


def newton_ctes(tag: str, rows: str, n: int, steps: int = 6, ridge: str = "1e-3") -> str:
    """``{tag}{steps}`` (g, beta): Newton steps from zero over ``rows`` (g, x, y, w)."""
    out = [f"{tag}0 AS (SELECT g, list_transform(range({n}), lambda i: 0e0) AS beta FROM {rows} GROUP BY g), {tag}w AS (SELECT g, sum(w) AS total FROM {rows} GROUP BY g)"]
    for t in range(steps):
        a = f"{tag}{t}"
        out.append(f"""{a}p AS MATERIALIZED (SELECT g, x, y, w, 1 / (1 + exp(-list_dot_product(x, beta))) AS p FROM {rows} JOIN {a} USING (g)),
 {a}h AS (SELECT g, i, j, sum(w * p * (1 - p) * x[i] * x[j]) / any_value(total) + CASE WHEN i = j AND i < {n} THEN {ridge} ELSE 0 END AS v
   FROM {a}p JOIN {tag}w USING (g), (SELECT unnest(range(1, {n + 1})) AS i), (SELECT unnest(range(1, {n + 1})) AS j) GROUP BY 1, 2, 3),
 {a}v AS (SELECT g, i, sum(w * (y - p) * x[i]) / any_value(total) AS v FROM {a}p JOIN {tag}w USING (g), (SELECT unnest(range(1, {n + 1})) AS i) GROUP BY 1, 2),
 {a}s AS MATERIALIZED (SELECT g, mat, rhs FROM (SELECT g, list(line ORDER BY i) AS mat FROM (SELECT g, i, list(v ORDER BY j) AS line FROM {a}h GROUP BY 1, 2) GROUP BY 1) m
   JOIN (SELECT g, list(v - CASE WHEN i < {n} THEN {ridge} * beta[i] ELSE 0 END ORDER BY i) AS rhs FROM {a}v JOIN {a} USING (g) GROUP BY 1) r USING (g)),
 {solve_ctes(a, a + "s", "g", n)},
 {tag}{t + 1} AS MATERIALIZED (SELECT g, {_add("beta", "z", n)} AS beta FROM {a} JOIN {a}sol USING (g))""")
    return ",\n ".join(out)


_STAGE1 = """e1 AS (SELECT vec_id, CASE WHEN label < 4 THEN 1 ELSE 0 END AS y, list_transform(embedding, lambda v: v::double * 200) AS v FROM embeddings),
 e2 AS (SELECT vec_id, y, v, list_avg(v) - list_stddev_pop(v) AS low FROM e1),
 e3 AS MATERIALIZED (SELECT g, list_append(list_transform(v, lambda q: least(greatest(q - low, 0), 100) / 100), 1e0) AS x, y, CASE WHEN y = 1 THEN 2e0 ELSE 1e0 END AS w,
    (concat('0x', substr(md5(concat(g, '-', vec_id)), 1, 8))::bigint + 0.5) / 4294967296.0 < 0.15 AS held FROM e2, (SELECT unnest([0, 1, 2]) AS g)),
 tr AS (SELECT * FROM e3 WHERE NOT held), """ + newton_ctes("n", "tr", 65)


@query(
    "train_stage1",
    """SELECT seed, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(mean, 6) AS mean_p FROM (
         SELECT g AS seed, count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn, avg(p) AS mean
         FROM (SELECT g, y, 1 / (1 + exp(-list_dot_product(x, beta))) AS p FROM e3 JOIN n6 USING (g) WHERE held) GROUP BY 1)""",
    recursive=True, extra=_STAGE1,
)
def train_stage1(t: Tables):
    scores = features.train_stage1(_stage1_samples(t), 64)[1]
    return scores.select("seed", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("mean_p").alias("mean_p"))


def _stage1_samples(t: Tables):
    samples = t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 4).cast("int").alias("y")
    )
    # Pixels as the detector sees them: from the scene's mean less one deviation, over 100 units.
    scaled = F.transform("x", lambda v: v * 200.0)
    mean = F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v) / F.size("x")
    samples = samples.withColumn("v", scaled).withColumn("m", mean)
    spread = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + (v - F.col("m")) ** 2) / F.size("v"))
    samples = samples.withColumn("low", F.col("m") - spread)
    pixels = F.transform("v", lambda v: F.least(F.greatest(v - F.col("low"), F.lit(0.0)), F.lit(100.0)) / 100.0)
    return samples.select("id", "y", pixels.alias("pixels"))


# The three features of the optional layers are absent in these scenes and zero.
_COLUMNS = [n for n in features.FEATURE_NAMES if n not in ("aot_swir_mean", "albedo_swir_mean", "cloud_frac_mean")]


def _stage2(t: Tables):
    from ..session import materialize

    tab = materialize(features.feature_table(features.scene_features(packed(t), KEY, "lat"), _labels(t), KEY), "features")
    return tab, *features.train_stage2(tab, "vec_id")


def _stage2_sql() -> str:
    """The map's constants come from the same seeded generator; everything else is computed again."""
    names, n = features.FEATURE_NAMES, 32
    m = features.fourier_map(names, [0.0] * len(names), [1.0] * len(names), n, 0)
    parts = []
    for w, b in zip(m.frequency, m.phase):
        dot = " + ".join([repr(float(b)) + "::double", *(f"z_{c} * {float(v)!r}::double" for c, v in zip(names, w) if c in _COLUMNS)])
        parts.append(f"cos({dot}) * sqrt(2e0 / {n})")
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _COLUMNS)
    scaled = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in _COLUMNS)
    d = n + 1
    return _PX + f""",
 ft AS MATERIALIZED (SELECT f.*, frac AS blob_frac_largest, aspect AS blob_aspect, CASE WHEN e.label < 4 THEN 1 ELSE 0 END AS y,
    row_number() OVER (PARTITION BY e.label < 4 ORDER BY md5(concat('0-', f.vec_id)), f.vec_id) <= round(count(*) OVER (PARTITION BY e.label < 4) * 0.15) AS held,
    concat('0x', substr(md5(concat('0-fold-', f.vec_id)), 1, 8))::bigint % 5 AS fold
    FROM ({_RAW}) f JOIN shape ON shape.s = f.vec_id JOIN embeddings e USING (vec_id)),
 st AS (SELECT {stats}, avg(y) AS rate FROM ft WHERE NOT held),
 zs AS (SELECT ft.*, {scaled}, CASE WHEN y = 1 THEN 0.5 / rate ELSE 0.5 / (1 - rate) END AS w FROM ft, st),
 mp AS MATERIALIZED (SELECT vec_id, y, held, fold, w, [{", ".join(parts)}, 1e0] AS x FROM zs),
 gr AS MATERIALIZED (SELECT fold, i, j, sum(w * x[i] * x[j]) AS v FROM mp, (SELECT unnest(range(1, {d + 1})) AS i), (SELECT unnest(range(1, {d + 1})) AS j) WHERE NOT held GROUP BY 1, 2, 3),
 rh AS MATERIALIZED (SELECT fold, i, sum(w * (2 * y - 1) * x[i]) AS v FROM mp, (SELECT unnest(range(1, {d + 1})) AS i) WHERE NOT held GROUP BY 1, 2),
 cf AS (SELECT c, f, c * 10 + f AS g FROM (SELECT unnest([1, 10, 100]) AS c), (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f)),
 sy AS MATERIALIZED (SELECT g, mat, rhs FROM (SELECT g, list(line ORDER BY i) AS mat FROM (
      SELECT g, i, list(v ORDER BY j) AS line FROM (SELECT g, i, j, sum(v) + CASE WHEN i = j AND i < {d} THEN 1e0 / any_value(c) ELSE 0 END AS v FROM gr JOIN cf ON fold <> f GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) m
   JOIN (SELECT g, list(v ORDER BY i) AS rhs FROM (SELECT g, i, sum(v) AS v FROM rh JOIN cf ON fold <> f GROUP BY 1, 2) GROUP BY 1) r USING (g)),
 {solve_ctes("q", "sy", "g", d)},
 mg AS MATERIALIZED (SELECT c, fold, y, list_dot_product(x, z) AS m FROM mp JOIN cf ON fold = f JOIN qsol USING (g) WHERE NOT held),
 cv AS (SELECT c, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1 FROM (
     SELECT c, fold, count(CASE WHEN m >= 0 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN m >= 0 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN m < 0 AND y = 1 THEN 1 END) AS fn FROM mg GROUP BY 1, 2) GROUP BY 1),
 bs AS (SELECT c FROM cv ORDER BY f1 DESC, c LIMIT 1),
 sg AS (SELECT 0 AS g, [m, 1e0] AS x, y, 1e0 AS w FROM mg JOIN bs USING (c)), {newton_ctes("t", "sg", 2)},
 pb AS MATERIALIZED (SELECT vec_id, mp.y, held, 1 / (1 + exp(-(list_dot_product(x, z) * beta[1] + beta[2]))) AS prob FROM mp, t6, bs JOIN cf ON cf.c = bs.c AND f = -1 JOIN qsol USING (g))"""


@query(
    "train_stage2",
    """SELECT c::double AS c, round(f1, 6) AS cv_f1, c = (SELECT c FROM bs) AS chosen, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall
       FROM cv, (SELECT count(CASE WHEN prob >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN prob >= 0.5 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN prob < 0.5 AND y = 1 THEN 1 END) AS fn FROM pb WHERE held) h""",
    recursive=True, extra=_stage2_sql(),
)
def train_stage2(t: Tables):
    m = _stage2(t)[2]
    return m.select("c", r6("cv_f1").alias("cv_f1"), "chosen", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("score_stage2", "SELECT vec_id, y, round(prob, 6) AS prob FROM pb", recursive=True, extra=_stage2_sql())
def score_stage2(t: Tables):
    tab, model, _ = _stage2(t)
    return tab.select("vec_id", "y", r6(model.prob()).alias("prob"))


@query(
    "run_detector",
    """SELECT scene_id, r0, c0, round(coalesce(avg(CASE WHEN norm > 0.6 THEN row END), r0 + 16), 6) AS row, round(coalesce(avg(CASE WHEN norm > 0.6 THEN col END), c0 + 16), 6) AS col,
              round(least(max(norm), 0.3 + count(CASE WHEN norm > 0.6 THEN 1 END) / count(*)), 6) AS score FROM (
         SELECT *, least(greatest(value - (avg(value) OVER w - stddev_pop(value) OVER w), 0), 100) / 100 AS norm FROM (
           SELECT scene_id, row, col, value / 10 AS value, r0, c0 FROM tiled, (SELECT unnest(range(0, 17, 16)) AS r0), (SELECT unnest(range(0, 17, 16)) AS c0)
           WHERE row BETWEEN r0 AND r0 + 31 AND col BETWEEN c0 AND c0 + 31) WINDOW w AS (PARTITION BY scene_id, r0, c0)) GROUP BY 1, 2, 3
       HAVING count(*) >= 64 AND max(norm) >= 0.5 AND 0.3 + count(CASE WHEN norm > 0.6 THEN 1 END) / count(*) >= 0.5""",
    extra="tiled AS (SELECT (scene_id - scene_id % 9) / 9 AS scene_id, row + 16 * (scene_id % 9 // 3) AS row, col + 16 * (scene_id % 3) AS col, value FROM v_scene)",
)
def run_detector(t: Tables):
    """Nine stacks side by side make a scene of 48 x 48 pixels, scanned with the default tiles."""
    s = F.col("scene_id")
    px = t.v_scene.select(
        F.floor(s / 9).alias("scene_id"), (F.col("row") + 16 * F.floor(s % 9 / 3)).cast("int").alias("row"),
        (F.col("col") + 16 * (s % 3)).cast("int").alias("col"), (F.col("value") / 10).alias("value"),
    )
    shape = px.select("scene_id").distinct().withColumn("n_rows", F.lit(48)).withColumn("n_cols", F.lit(48))
    stages = {"cnn": F.col("norm_max"), "svc": F.col("frac_high") + 0.3}
    d = features.run_detector(px, shape, ["scene_id"], stages)
    return d.select("scene_id", "r0", "c0", r6("row").alias("row"), r6("col").alias("col"), r6("score").alias("score"))


@query(
    "cascade_detector",
    """SELECT vec_id, round(coalesce(row, 4), 6) AS row, round(coalesce(col, 4), 6) AS col, round(least(p, prob), 6) AS score, round(p, 6) AS pixel_prob, round(prob, 6) AS feature_prob
       FROM (SELECT vec_id, 1 / (1 + exp(-list_dot_product(list_append(list(norm ORDER BY row, col), 1e0), any_value(beta)))) AS p,
               avg(CASE WHEN norm > 0.6 AND value IS NOT NULL THEN row END) AS row, avg(CASE WHEN norm > 0.6 AND value IS NOT NULL THEN col END) AS col, count(value) AS n
             FROM px, n6 WHERE g = 0 GROUP BY 1) JOIN pb USING (vec_id) WHERE n >= 32 AND p >= 0.3 AND prob >= 0.4""",
    recursive=True, extra=_stage2_sql() + ", " + _STAGE1,
)
def cascade_detector(t: Tables):
    """The fitted models as stages over scenes of one window each, with a threshold of their own."""
    px = packed(t)
    first = features.logistic_stage(features.train_stage1(_stage1_samples(t), 64, (0,))[0][0], 0.3)
    second = features.Stage(_stage2(t)[1].prob(), 0.4)
    shape = px.select("vec_id").distinct().withColumns({"n_rows": F.lit(8), "n_cols": F.lit(8)})
    # The features' latitude is the scene's; the windows of one scene share it.
    d = features.run_detector(px, shape, KEY, {"pixel": first, "feature": second}, window=8, stride=8, min_finite=32, context=True, lat_center="lat")
    return d.select("vec_id", *[r6(c).alias(c) for c in ("row", "col", "score", "pixel_prob", "feature_prob")])


_QUEUE = "SELECT row_number() OVER (ORDER BY md5(concat('20270307-', id)), id) AS position, id, is_control FROM v_labels"


@query("render_pack", _QUEUE)
def render_pack(t: Tables):
    lab = t.v_labels
    return labeling.render_pack(lab.where("NOT is_control"), lab.where("is_control"))


@query(
    "render_pack_hash",
    "SELECT (SELECT count(*) FROM leaf) AS n, substr(h, 1, 16) AS pack_sha256 FROM tree6",
    extra=f"leaf AS (SELECT 1 AS one, position - 1 AS pos, sha256(concat_ws(':', position, id, is_control)) AS h FROM ({_QUEUE})), " + tree_ctes("leaf", "one", 16, 6),
)
def render_pack_hash(t: Tables):
    return labeling.pack_hash(render_pack(t), 16)


@query(
    "label_subsample",
    "SELECT doc_id AS id FROM documents ORDER BY md5(concat('20270307-', doc_id)), doc_id LIMIT 150",
)
def label_subsample(t: Tables):
    return labeling.label_subsample(t.documents.select(F.col("doc_id").alias("id")))


@query(
    "cue_log",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS det_date, CASE WHEN o_orderkey % 7 >= 4 OR (o_orderkey % 80) / 10e0 >= 5 THEN 'cue_sentinel2' ELSE 'watch' END AS action,
              count(*) AS n, count(CASE WHEN o_orderkey % 7 < 4 THEN 1 END) AS n_short FROM orders GROUP BY 1, 2""",
)
def cue_log(t: Tables):
    import uuid

    d = cue_decision(F.col("o_orderkey") % 7, (F.col("o_orderkey") % 80) / 10.0)
    rows = t.orders.select(F.col("o_orderdate").alias("det_date"), d.alias("d")).select("det_date", "d.*")
    target = f"{shared_dir(t.spark)}/cue-{uuid.uuid4().hex}"
    labeling.cue_log(rows, target)
    back = t.spark.read.schema("det_date string, action string, reason string, counterfactuals map<string,string>").json(target)
    return back.groupBy("det_date", "action").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.map_contains_key("counterfactuals", "persistence")).alias("n_short")
    )
