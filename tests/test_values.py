"""Hand-checked values of expressions, selections and aggregates."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtrace.functions import geo, naming, numeric, policy, retrieval, screening
from airtrace.operators import background, calibration, evaluate, features, quantify, report, scenes, stencil
from airtrace.operators.ranking import exact_quantiles, row_numbers
from airtrace.sources import catalog, layers, manifest, records


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_geo_and_wind(spark):
    r = one(
        spark, zero=geo.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)),
        degree=geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
        easterly=retrieval.wind_from_direction(F.lit(-4.0), F.lit(0.0)),
        legacy=retrieval.wind_from_direction(F.lit(-4.0), F.lit(0.0), legacy=True),
        mass=retrieval.column_mass(F.lit(1.0)), alt=retrieval.column_mass_alt(F.lit(1.0)),
    )
    assert r["zero"] == 0 and r["degree"] == pytest.approx(111.195, abs=1e-3)
    assert r["easterly"] == pytest.approx(90) and r["legacy"] == pytest.approx(270)
    assert r["mass"] == pytest.approx(5.7214e-6, rel=1e-4) and r["alt"] == pytest.approx(5.7286e-6, rel=1e-4)


def test_nan_and_infinity_never_pass(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.9,), (3.0,), (None,)], "z double")
    got = [r[0] for r in df.select(screening.exceeds("z", 3.0)).collect()]
    assert got == [False, False, False, True, False]


def test_two_negative_bands_are_invalidated(spark):
    d = retrieval.digital_number(F.lit(0.05), -1000.0)
    r = one(spark, valid=d["valid"], negative=d["negative"], null=d["dn_or_null"])
    assert (r["valid"], r["negative"], r["null"]) == (False, True, None)


def test_constant_stack_has_no_score_and_spike_is_found(spark):
    rows = [(0, f, 0, 0, 1800.0, 1.0) for f in range(20)]
    rows += [(0, f, 0, 1, 1800.0 + (f * 7) % 11 + (120 if f == 19 else 0), 1.0) for f in range(20)]
    df = spark.createDataFrame(rows, "stack_id int, frame int, row int, col int, value double, qa double")
    out = background.screen_anomalies(df, ["stack_id", "row", "col"], 30).collect()
    assert all(r["z"] is None for r in out if r["col"] == 0)
    assert [r["frame"] for r in out if r["anomalous"]] == [19]


def test_screening_does_not_depend_on_partitions(spark):
    rows = [(0, f, r, 0, float((f * 13 + r * 5) % 50 * 3), 1.0) for f in range(25) for r in range(6)]
    df = spark.createDataFrame(rows, "stack_id int, frame int, row int, col int, value double, qa double")
    seen = set()
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str(sorted(map(tuple, background.screen_anomalies(df, ["stack_id", "row", "col"]).collect()), key=str)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_mass_rate_and_monte_carlo(spark):
    rows = [(0, r, c, 1000.0 if r < 2 and c < 2 else 0.0, r < 2 and c < 2) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(rows, "s int, row int, col int, value double, in_mask boolean")
    m = quantify.rate_estimate(quantify.integrated_mass(df, ["s"], 400.0), F.lit(3.0), 400.0).first()
    assert m["n_pixels"] == 4 and m["length_m"] == 40.0
    assert m["ime_kg"] == pytest.approx(4 * 400 * 5.7214e-3, rel=1e-3)
    assert m["q_kg_h"] == pytest.approx(m["ime_kg"] * 1.44 * 3600 / 40)
    wide = spark.createDataFrame([(0, i // 10, i % 10, 900.0, True) for i in range(80)], df.schema)
    u = spark.createDataFrame([(0, 3.0)], "s int, u10 double")
    q = quantify.rate_estimate(quantify.integrated_mass(wide, ["s"], 400.0), F.lit(3.0), 400.0).first()["q_kg_h"]
    ci = quantify.rate_monte_carlo(wide, ["s"], u, 400.0, draws=300).first()
    assert ci["draws"] == 300 and ci["ci_low"] < q < ci["ci_high"]
    assert ci["q_mean"] / q == pytest.approx(0.949, abs=0.04)


def test_gates(spark):
    rows = [(0, i, 8667.0 if i < 5 else float(i % 7), i < 5, True) for i in range(100)]
    rows += [(1, i, 170.0 if i < 5 else float(i % 7), i < 5, True) for i in range(100)]
    rows += [(2, i, 5.0, True, True) for i in range(10)]
    df = spark.createDataFrame(rows, "s int, row int, value double, in_mask boolean, valid boolean")
    g = {r["s"]: r for r in quantify.honesty_gates(df, ["s"]).collect()}
    assert g[0]["artifact_dominated"] and "unphysical" in g[0]["reasons"][0] and len(g[0]["reasons"]) == 1
    assert not g[1]["artifact_dominated"]
    assert g[2]["sigma_col_ppb"] == float("inf") and len(g[2]["reasons"]) == 2


def test_despeckle_keeps_block_interior(spark):
    size = 40
    vals = {(r, c): float((r * 7 + c * 3) % 5) for r in range(size) for c in range(size)}
    vals.update({(r, c): 120.0 for r in range(10, 14) for c in range(10, 16)})
    vals[(30, 30)] = 150.0
    df = spark.createDataFrame([(0, r, c, v) for (r, c), v in vals.items()], "s int, row int, col int, value double")
    shape = spark.createDataFrame([(0, size, size)], "s int, n_rows int, n_cols int")
    got = {(r["row"], r["col"]) for r in stencil.plume_mask(df, shape, ["s"]).collect()}
    assert (11, 12) in got and (30, 30) not in got


def test_reference_pass_rules(spark):
    rows = [
        ("e", "near", 1, 0.0, 1.0, 0.0, 0), ("e", "far", 13, 0.0, 1.0, 0.0, 1), ("e", "cloudy", 5, 0.2, 1.0, 0.0, 2),
        ("e", "bare", 5, 0.0, 0.9, 0.0, 3), ("e", "own", 5, 0.0, 1.0, 4.0, 4), ("e", "ok", 5, 0.0, 0.99, 1.0, 5),
        ("none", "near", 1, 0.0, 1.0, 0.0, 6),
    ]
    df = spark.createDataFrame(rows, "event string, pass_id string, dt_days int, cloud double, corr double, mbsp double, o int")
    got = {r["event"]: r["chosen"] for r in scenes.select_reference_pass(df, "o").collect()}
    assert got == {"e": "ok", "none": None}
    reasons = [r[0] for r in scenes.score_passes(df).orderBy("o").select("rejected_reason").collect()]
    assert reasons[:5] == ["inside 2d exclusion zone", "outside +/-window", "cloud 0.20 > 0.05", "surface corr 0.900 < 0.95", "own plume 4.0sigma"]


def test_cue_rules(spark):
    df = spark.createDataFrame([(5, 3.2), (1, 8.0), (1, 3.5)], "n int, z double")
    got = [tuple(r) for r in df.select(policy.cue_decision("n", "z").alias("d")).select("d.action", "d.reason").collect()]
    assert got == [
        ("cue_sentinel2", "persistent source (5 passes)"), ("cue_sentinel2", "transient ultra-emission (z=8.0 >= 5.0)"),
        ("watch", "weak transient (z=3.5 < 5.0)"),
    ]


def test_catalog_forms(spark):
    alias = spark.createDataFrame([("x", "2024-07-26", "1.5", "2.5", "3")], "plume_id string, date string, longitude string, latitude string, flux string")
    r = catalog.canonical_events(alias).first()
    assert (r["id"], r["date"], r["lon"], r["rate_t_h"]) == ("x", date(2024, 7, 26), 1.5, 3.0)
    raw = spark.createDataFrame([("20240726.0", "1", "2", 0), ("bad", "1", "2", 1), ("20240727", "inf", "2", 2), ("20240728", "1", "2", 3)], "day string, lon string, lat string, o int")
    got = catalog.canonical_events(raw, [F.col("o")]).orderBy("id").collect()
    assert [(r["id"], r["date"].day) for r in got] == [("sron-00000", 26), ("sron-00001", 28)]
    with pytest.raises(ValueError):
        catalog.canonical_events(alias.drop("longitude"))


def test_catalog_csv_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,lon,lat,source_rate_t/h\n" + "".join(f"202407{d:02d},1,2,{d}\n" for d in range(1, 29)))
    got = catalog.load_csv(spark, str(tmp_path / "c.csv")).orderBy("id").collect()
    assert [r["rate_t_h"] for r in got] == [float(d) for d in range(1, 29)] and got[-1]["id"] == "sron-00027"


def test_schema_drift_history(spark, tmp_path):
    path = str(tmp_path / "m")
    a = spark.createDataFrame([(1, "x")], "p int, q string")
    b = spark.createDataFrame([(1, 2.0)], "p int, q double")
    first = manifest.check_drift(a, "s", path)
    assert manifest.check_drift(a.select("q", "p"), "s", path) == first
    with pytest.raises(manifest.SchemaDriftError):
        manifest.check_drift(b, "s", path)
    manifest.check_drift(b, "s", path, allow_new_schema=True)
    assert manifest.read_manifest(spark, path).count() == 3
    assert manifest.read_manifest(spark, str(tmp_path / "absent")).count() == 0


def test_hourly_winds(spark):
    text = '{"hourly":{"time":["2024-07-26T00:00","2024-07-26T01:00","2024-07-26T02:00"],"wind_speed_10m":[4,null,8],"wind_direction_10m":[90,90,270]}}'
    got = layers.parse_hourly_winds(spark.createDataFrame([(text,)], "json string")).orderBy("time").collect()
    assert [round(r["u10"], 6) for r in got] == [-4.0, 8.0]


def test_noise_keys_and_scene_names(spark):
    k = naming.noise_key(F.lit("korpezhe_2026-08-03_cloudscreened_50d_v2"))
    r = one(spark, **k, orbit=naming.relative_orbit(F.lit("S2A_X_R063_T")), none=naming.relative_orbit(F.lit("S2A_X")),
            bad=naming.noise_key(F.lit("nodate"))["ok"])
    assert (r["basin"], r["day"], r["cloud_screened"], r["baseline_days"], r["extra"]) == ("korpezhe", date(2026, 8, 3), True, 50, ["v2"])
    assert (r["orbit"], r["none"], r["bad"]) == ("R063", "R???", False)


def test_roc_and_undefined_scores(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, False)], "score double, is_true boolean")
    pts = evaluate.roc_curve(df).orderBy(F.col("threshold").desc()).collect()
    assert (pts[0]["tpr"], pts[0]["fpr"]) == (0.5, 0.0) and (pts[-1]["tpr"], pts[-1]["fpr"]) == (1.0, 1.0)
    p, r, f = evaluate.precision_recall(F.lit(0), F.lit(0), F.lit(3))
    assert tuple(one(spark, p=p, r=r, f=f)) == (None, 0.0, None)


def test_bootstrap_brackets_share(spark):
    df = spark.createDataFrame([(i, 5, 3 + (i % 3) - 1) for i in range(40)], "cluster int, n int, tp int")
    r = evaluate.cluster_bootstrap(df, 300).first()
    assert r["ci_low"] < 0.6 < r["ci_high"] and r["ci_high"] - r["ci_low"] < 0.2


def test_bootstrap_equals_a_plain_loop(spark, monkeypatch):
    """Also where a draw is cut into several blocks of picks, and where a block holds several draws."""
    def mix(h):
        h = ((h ^ (h >> 16)) * 0x85EBCA6B) % 2**32
        h = ((h ^ (h >> 13)) * 0xC2B2AE35) % 2**32
        return h ^ (h >> 16)

    def step(key, count):
        return (key + (count + 1) * 0x9E3779B9) % 2**32

    pairs = sorted((3 + i % 4, i % 3) for i in range(23))
    shares = []
    for draw in range(50):
        one = mix(step(11, draw))
        picks = [mix(mix(step(one, i)) ^ mix(one ^ 0x5BD1E995)) % 23 for i in range(23)]
        shares.append(sum(pairs[p][1] for p in picks) / sum(pairs[p][0] for p in picks))
    want = np.percentile(shares, [2.5, 97.5])
    df = spark.createDataFrame([("x", i, n, tp) for i, (n, tp) in enumerate(pairs)], "g string, cluster int, n int, tp int")
    for block in (5, 100, 1 << 17):
        monkeypatch.setattr(evaluate, "PICK_BLOCK", block)
        r = evaluate.cluster_bootstrap(df, 50, 11, ["g"]).first()
        assert r["g"] == "x" and np.allclose([r["ci_low"], r["ci_high"]], want)


def test_agreement_report(spark):
    """A matched pair, a missed reference and a false detection; the note counts the settings in the full branch."""
    day = date(2025, 3, 1)
    det = spark.createDataFrame([("d1", day, 54.0, 39.0), ("d2", day, 10.0, 10.0), ("d3", day, 30.0, 30.0)], "id string, date date, lon double, lat double")
    ref = [("strict", "r1", day, 54.05, 39.0), ("strict", "r2", day, 80.0, 39.0)]
    ref += [("lenient", f"l{i}", day, 100.0, -40.0 + i * 0.3) for i in range(31)]
    rows = spark.createDataFrame(ref, "mode string, id string, date date, lon double, lat double")
    study = evaluate.agreement_study(det, rows, draws=50).cache()
    got = {r["mode"]: r for r in study.collect()}
    m = got["strict"]
    assert (m["n_det"], m["n_ref"], m["n_matched"]) == (3, 2, 1) and m["precision"] == pytest.approx(1 / 3) and m["recall"] == 0.5
    assert m["branch"] == "descriptive (robustness: 0/9 combos land in 'full' branch)" and m["interpretation"].startswith("Strict mode")
    # 31 places 33 km apart: all are clusters of their own up to 25 km, half of them at 37.5 km.
    assert got["lenient"]["branch"] == "full (robustness: 6/9 combos land in 'full' branch)" and got["lenient"]["n_matched"] == 0
    table = evaluate.sensitivity_table(study).collect()
    assert len(table) == 18 and {r["n_ref_clusters"] for r in table if r["mode"] == "lenient"} == {31, 16}


def test_kappa(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b")], "x string, y string")
    flat = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    cross = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    assert evaluate.cohen_kappa(same, "x", "y").first()["kappa"] == 1.0
    assert evaluate.cohen_kappa(flat, "x", "y").first()["kappa"] == 1.0
    assert evaluate.cohen_kappa(cross, "x", "y").first()["kappa"] < 0


def test_cubic_fit_recovers_coefficients(spark):
    xs = [i / 400 for i in range(77)]
    df = spark.createDataFrame([("S", x, 3e4 * x + 8e4 * x**2 + 2e5 * x**3) for x in xs], "k string, x double, ppb double")
    r = calibration.fit_curves(df, ["k"]).first()
    assert r["c1"] == pytest.approx(3e4, rel=1e-6) and r["c3"] == pytest.approx(2e5, rel=1e-3)
    assert r["max_relative_residual"] < 1e-6


def test_calibration_clamps_and_falls_back(spark):
    grid = [("S2B", s, v, s + v, 0.0, 0.0) for s in (10.0, 20.0, 30.0) for v in (0.0, 10.0)]
    table = spark.createDataFrame(grid, "satellite string, sza double, vza double, c1 double, c2 double, c3 double")
    sc = spark.createDataFrame([(0, "S2C", 25.0, 5.0), (1, "S2B", 99.0, -3.0), (2, "S2B", 10.0, 10.0)], "i int, satellite string, sza double, vza double")
    got = {r["i"]: r["c1"] for r in calibration.attach_curve(sc, table).collect()}
    assert got == {0: pytest.approx(30.0), 1: pytest.approx(30.0), 2: pytest.approx(20.0)}


def test_limits_are_monotone(spark):
    def q(**k):
        return quantify.detection_limit(**k)
    r = one(spark, base=q(sigma_ppb=F.lit(10.0), u10=F.lit(3.0)), noisy=q(sigma_ppb=F.lit(20.0), u10=F.lit(3.0)), windy=q(sigma_ppb=F.lit(10.0), u10=F.lit(6.0)))
    assert r["base"] < r["windy"] and r["noisy"] == pytest.approx(2 * r["base"])


def test_ranks_and_quantiles_on_one_hot_group(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("v"), F.lit("g").alias("g"), "id")
    q = exact_quantiles(df, ["g"], "v", {"lo": 0.025, "mid": 0.5, "hi": 1.0}).first()
    assert (q["lo"], q["mid"], q["hi"], q["n"]) == (0.0, 4.5, 9.0, 1000)
    ranked = row_numbers(df, [F.col("v"), F.col("id")], "r", ["g"])
    assert [r["r"] for r in ranked.orderBy("v", "id").collect()] == list(range(1, 1001))


def test_all_missing_scene_features_are_zero(spark):
    df = spark.createDataFrame([(0, r, c, None) for r in range(4) for c in range(4)], "s int, row int, col int, value double")
    row = features.scene_features(df, ["s"]).first()
    assert row["blob_aspect"] == 1.0 and sum(row[n] for n in features.FEATURE_NAMES) == 1.0


def test_detector_fires_on_plume_only(spark):
    rows = []
    for r in range(64):
        for c in range(64):
            bump = 200.0 * 2.718281828 ** (-((r - 20) ** 2 + (c - 16) ** 2) / 18.0)
            rows.append((0, r, c, 1800.0 + (r * 31 + c * 17) % 7 + bump))
            rows.append((1, r, c, 1800.0))
    df = spark.createDataFrame(rows, "s int, row int, col int, value double")
    shape = spark.createDataFrame([(0, 64, 64), (1, 64, 64)], "s int, n_rows int, n_cols int")
    d = features.run_detector(df, shape, ["s"], {"p": F.col("norm_max")}).collect()
    assert d and {x["s"] for x in d} == {0}
    best = max(d, key=lambda x: (x["score"], -abs(x["row"] - 20)))
    assert abs(best["row"] - 20) < 4
    tiles = stencil.tile_windows(df.where("s = 0"), spark.createDataFrame([(0, 70, 80)], shape.schema), ["s"])
    assert tiles.select("r0", "c0").distinct().count() == 12 or tiles.select("r0", "c0").distinct().count() == 3 * 4
    with pytest.raises(ValueError):
        features.run_detector(df, shape, ["s"], {})


def test_pushdown_reaches_the_scan(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_totalprice > 1000").select("o_orderkey")
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_sensitivity_grid_counts_each_setting_once(spark):
    """Windows that round to the same days stay separate settings."""
    rows = [(f"e{i}", date(2025, 1, 1), 10.0 * i, 10.0, 1.0) for i in range(4)]
    events = spark.createDataFrame(rows, "id string, date date, lon double, lat double, score double")
    grid = evaluate.sensitivity_grid(events, events, cluster_days=1).collect()
    assert len(grid) == 9 and {r["n_ref_clusters"] for r in grid} == {4}


def test_empty_comparisons_fail(spark):
    none = spark.createDataFrame([], "id string, pass2_final string, is_control boolean, x string, y string")
    with pytest.raises(Exception, match="no labelled controls"):
        evaluate.control_hit_rate(none.select("id", "pass2_final"), none.select("id", "is_control")).collect()


def test_records_are_replaced_by_id(spark, tmp_path):
    stored = spark.createDataFrame([("gone", "withdrawn")], "event_id string, status string")
    target = f"file://{tmp_path}/records"
    for value in (1.0, 2.0):
        new = spark.createDataFrame([("a", "p", value), ("gone", "p", value), ("b", None, value)], "event_id string, basin string, q double")
        records.write_records(new, stored, target)
    got = {r["event_id"]: r["q"] for r in records.read_written(spark, target, new.schema).collect()}
    assert got == {"a": 2.0, "b": 2.0}


def test_texts_of_numbers(spark):
    rows = [(0.125, "0.12"), (0.375, "0.38"), (float("inf"), "inf"), (-float("inf"), "-inf"), (2.0, "2.00")]
    df = spark.createDataFrame(rows, "x double, want string")
    assert all(r[0] == r[1] for r in df.select(numeric.fixed_text("x", 2), "want").collect())


def test_run_records_keep_nulls_and_take_overrides(spark):
    """A detection without a rate says null; extra entries replace core entries; nested values are objects."""
    import json

    fields = "event_id string, basin string, det_date string, lon double, lat double, event_class string, z_peak double, cue_action string, cue_reason string, "
    fields += "context_verdict string, quant struct<q_kg_h: double, n_pixels: long>, wind_source string, u10_ms double, more map<string,string>"
    rows = [
        ("e1", "b", "2025-01-01", 1.0, 2.0, "plume", 6.5, "cue_sentinel2", "strong", "no_infrastructure", (12.5, 30), "ERA5", 3.0, {"basin": "other", "note": "v2"}),
        ("e2", "b", "2025-01-02", 1.0, None, "plume", 4.5, "watch", None, "no_infrastructure", None, "ERA5", None, None),
    ]
    made = report.run_records(spark.createDataFrame(rows, fields), config="k: 1\n", commit="c0", extra="more")
    one, two = (json.loads(r["j"]) for r in made.orderBy("event_id").select(F.to_json("record").alias("j")).collect())
    assert set(report.RECORD_FIELDS) | {"note"} == set(one) and set(report.RECORD_FIELDS) == set(two)
    assert (one["basin"], one["note"], one["quant"]) == ("other", "v2", {"q_kg_h": 12.5, "n_pixels": 30})
    assert two["quant"] is None and two["u10_ms"] is None and two["lat"] is None and two["cue_reason"] is None and two["basin"] == "b"
    assert one["config_sha256"] == two["config_sha256"] and len(one["config_sha256"]) == 64 and one["code_commit"] == "c0"
    assert report.run_records(spark.createDataFrame([], fields), config="").count() == 0


def test_a_reference_pixel_is_shuffled_once(spark):
    """Shifts are told apart after the join, also across the squares in which pixels meet and left of zero."""
    from airtrace.operators.align import align_shift

    rng = np.random.default_rng(3)
    image = {(r, c): float(v) for (r, c), v in np.ndenumerate(rng.random((24, 24)))}
    target = spark.createDataFrame([(1, r - 9, c - 5, v) for (r, c), v in image.items()], "k int, row int, col int, value double")
    moves = {0: (0, 0), 1: (2, -1), 2: (-2, 2)}
    rows = [(1, p, r - 9 - y, c - 5 - x, v) for p, (y, x) in moves.items() for (r, c), v in image.items()]
    out = align_shift(target, spark.createDataFrame(rows, "k int, pass_id int, row int, col int, value double"), ["k"], ["pass_id"], 3)
    assert {r["pass_id"]: (round(r["dy"]), round(r["dx"]), round(r["peak"], 9)) for r in out.collect()} == {p: (y, x, 1.0) for p, (y, x) in moves.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not [line for line in plan.splitlines() if "Generate" in line and "dy#" in line]
