"""Noise anchors by reduced lookup and the rate record against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtrace.functions.numeric import uniform32
from airtrace.operators import limits, quantify

RUN = "event_id string, basin string, det_date date, status string, lat double, lon double, u10_ms double, cloud_screening boolean, target_scene string, background_scene string, sigma double"


def test_noise_keys_meet_their_best_run(spark):
    rng = random.Random(9)
    runs = []
    for i in range(400):
        gap = rng.choice([10, 20, 30])
        target = rng.choice(["", "S2A_MSIL1C_20250131T101031_N1"])
        back = f"S2A_MSIL1C_202501{31 - gap:02d}T101031_N1"
        runs.append((f"R{i:03d}", f"B{rng.randrange(4)}", f"2025-01-3{rng.randrange(2)}", rng.choice(["quotable", "diagnostic", "withdrawn"]), 1.0, 2.0, 3.0, rng.choice([True, False, None]), target, back, i / 1000))
    keys = [(f"B{b}_2025-01-3{d}{s}{g}", 0.01) for b in range(5) for d in range(2) for s in ("", "_cloudscreened", "_unscreened") for g in ("", "_10d", "_20d")]
    basins = [(f"B{b}", 0.0, 0.0, 1.0, 1.0, "heterogeneous", 1000.0) for b in range(5)]
    frames = (
        spark.createDataFrame(keys, "key string, sigma double"),
        spark.createDataFrame(runs, RUN.replace("date date", "date string")).withColumn("det_date", F.to_date("det_date")),
        spark.createDataFrame(basins, "basin string, lon_min double, lat_min double, lon_max double, lat_max double, surface_class string, pressure double"),
    )
    got = {r["key"]: r for r in limits.noise_scenes(*frames).collect()}
    for key, _ in keys:
        basin, day, *rest = key.split("_")
        screen = {"cloudscreened": True, "unscreened": False}.get(rest[0] if rest else "")
        gap = int(rest[-1][:-1]) if rest and rest[-1].endswith("0d") else None
        fit = [
            r for r in runs if r[1] == basin and r[2] == day and (screen is None or bool(r[7]) == screen)
            and (gap is None or (r[8] and int(r[9][17:19]) == 31 - gap))
        ]
        best = min(fit, key=lambda r: (r[3] != "quotable", r[0]), default=None)
        found = got[key]
        assert (found["event_id"], found["run_status"], found["recorded_sigma_ppb"]) == ((best[0], best[3], best[10]) if best else (None, "absent", None))
        assert found["quotable"] == (best is None or best[3] == "quotable") and found["provisional"]


def test_rate_record_equals_plain_draws(spark):
    rng = random.Random(2)
    rows = [(s, r, c, None if rng.random() < 0.1 else rng.uniform(100, 900), s < 3 and (r + c) % 2 == 0) for s in range(4) for r in range(30) for c in range(30)]
    df = spark.createDataFrame(rows, "s int, row int, col int, value double, in_mask boolean").repartition(5)
    u = spark.createDataFrame([(s, 1.0 + s) for s in range(4)], "s int, u10 double")
    got = {r["s"]: r for r in quantify.rate_record(df, ["s"], u, 400.0, draws=40).collect()}
    assert got[3]["n_pixels"] == 0 and got[3]["q_kg_h"] == got[3]["ci_low"] == got[3]["ci_high"] == 0.0
    px = df.where("in_mask").select("s", "value", quantify.pick(F.lit(1 << 32), F.lit(20270307), F.col("s").cast("string"), F.col("row"), F.col("col"), F.lit("pixel")).alias("k"))
    factor = spark.range(40).select(F.col("id").alias("draw"), *[quantify.gaussian(F.lit(20270307), F.lit(str(s)), F.col("id"), F.lit("wind")).alias(f"g{s}") for s in range(3)]).toPandas()
    each = px.toPandas()
    per_ppb = quantify.integrated_mass(spark.createDataFrame([(1000.0, True)], "value double, in_mask boolean"), [], 1.0).first()["ime_kg"] / 1000
    for s in range(3):
        mine = each[each["s"] == s]
        qs = []
        for d in range(40):
            u = [uniform32(mine["k"].to_numpy(np.uint64), np.uint64(3 * d + j)) for j in range(3)]
            keep = u[0] < 0.9
            noisy = mine["value"].to_numpy(float) + 15 * np.sqrt(-2 * np.log(u[1])) * np.cos(2 * np.pi * u[2])
            w = min(max(1 + 0.25 * factor[f"g{s}"][d], 0.5), 1.5)
            qs.append(np.nansum(noisy[keep]) * per_ppb * 400 * (0.33 * (1 + s) + 0.45) * w * 3600 / np.sqrt(keep.sum() * 400))
        assert got[s]["ci_low"] == pytest.approx(np.percentile(qs, 2.5)) and got[s]["ci_high"] == pytest.approx(np.percentile(qs, 97.5))
        assert got[s]["ci_low"] < got[s]["q_kg_h"] < got[s]["ci_high"] and got[s]["n_pixels"] == len(mine) == 450
    flat = uniform32(np.arange(100_000, dtype=np.uint64), np.uint64(0))
    assert abs(flat.mean() - 0.5) < 0.01 and abs(np.histogram(flat, 10)[0] - 10_000).max() < 500
