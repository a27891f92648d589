"""What is shuffled and read for a result, told by the plan and by the number of records that stages write."""

import random
import uuid

from pyspark.sql import functions as F

from airtrace.operators import evaluate, limits, quantify, scenes, stencil
from airtrace.session import materialize, shared_dir
from airtrace.sources import records
from airtrace.streaming import ingest, persistence


def shuffled(spark, df) -> int:
    """Records that the job of ``df`` writes to shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pair_references_reads_the_passes_once_for_targets_and_once_for_pairs(spark, tmp_path):
    rows = [(e, e * 100 + i, f"S2{'AB'[i % 2]}_X_R0{10 + i % 3}_{e}_{i}", -16 + (i * 7) % 33, [0.0, 0.01, 0.03][i % 3 if e else 0]) for e in range(3) for i in range(60)]
    spark.createDataFrame(rows, "event int, k int, scene string, dt_days int, nodata double").write.parquet(str(tmp_path / "p"))
    passes = spark.read.parquet(str(tmp_path / "p"))
    targets = scenes.target_scene_pick(passes, "k")
    out = scenes.pair_references(targets, passes, "k")
    assert plan(out).count("FileScan") == 2
    got = {}
    for r in out.collect():
        got.setdefault(r["event"], []).append((r["rank"], r["dt_days"], r["scene"], r["same_orbit"]))
    for t in targets.collect():
        fit = [r for r in rows if r[0] == t["event"] and r[4] <= 0.02 and r[2][:3] == t["scene"][:3] and 3 <= t["dt_days"] - r[3] <= 21]
        first = {}
        for r in sorted(fit, key=lambda r: r[1]):
            first.setdefault((r[2].split("_")[2] == t["scene"].split("_")[2], r[3]), r)
        same = sorted((d for s, d in first if s), reverse=True)[:3]
        cross = sorted((d for s, d in first if not s and d not in same), reverse=True)[:3 - len(same)]
        want = sorted([(d, first[True, d][2], True) for d in same] + [(d, first[False, d][2], False) for d in cross], reverse=True)
        assert sorted(got[t["event"]]) == [(i + 1, *w) for i, w in enumerate(want)]


def test_rate_draws_are_shuffled_by_scene(spark):
    rows = [(s, r, c, 100.0 + r + c) for s in range(40) for r in range(6) for c in range(6)]
    df = spark.createDataFrame(rows, "s int, row int, col int, value double").withColumn("in_mask", F.lit(True)).repartition(7, "row", "col")
    u = spark.createDataFrame([(s, 1.0 + s) for s in range(40)], "s int, u10 double")
    # A record per pixel, chunk and scene, none per draw.
    assert shuffled(spark, quantify.rate_monte_carlo(df, ["s"], u, 400.0, draws=300)) < 4 * len(rows)


def test_opening_and_closing_by_words(spark):
    rng = random.Random(4)
    mask = {(r, c) for r in range(-3, 9) for c in range(-70, 140) if rng.random() < 0.75}
    df = spark.createDataFrame([(1, r, c) for r, c in mask], "s int, row int, col int")
    for eight in (True, False):
        near = stencil.SQUARE if eight else stencil.CROSS

        def grow(m):
            return {(r + a, c + b) for r, c in m for a, b in near}

        def shrink(m):
            return {(r, c) for r, c in m if all((r + a, c + b) in m for a, b in near)}

        for op, steps in ((stencil.binary_open, (shrink, grow)), (stencil.binary_close, (grow, shrink)), (stencil.dilate, (grow,)), (stencil.erode, (shrink,))):
            want = mask
            for step in steps:
                want = step(want)
            out = op(df, ["s"], eight=eight)
            assert dict(out.dtypes) == dict(df.dtypes)
            assert sorted((r["row"], r["col"]) for r in out.collect()) == sorted(want)
    # Every pixel is shuffled once, its neighbours are not.
    assert shuffled(spark, stencil.binary_close(df, ["s"])) < 2 * len(mask)


def test_ingest_sorts_no_whole_file(spark):
    df = spark.createDataFrame([(str(i % 50), i, "x" * 9) for i in range(100)], "id string, n int, t string")
    out = ingest.first_copies(df, "id")
    # Both steps of the removal stand above the shuffle.
    assert out.count() == 50 and plan(out).index("partial_first") < plan(out).index("Exchange")


def test_noise_keys_are_read_once(spark, tmp_path):
    spark.createDataFrame([("B1_2025-01-05", 0.01), ("B2_2025-01-05_unscreened_10d", 0.02)], "key string, sigma double").write.parquet(str(tmp_path / "k"))
    runs = spark.createDataFrame([], "event_id string, basin string, det_date date, status string, lat double, lon double, u10_ms double, cloud_screening boolean, target_scene string, background_scene string")
    basins = spark.createDataFrame([(f"B{b}", 0.0, 0.0, 1.0, 1.0, "arid", 1000.0) for b in (1, 2)], "basin string, lon_min double, lat_min double, lon_max double, lat_max double, surface_class string, pressure double")
    out = limits.noise_scenes(spark.read.parquet(str(tmp_path / "k")), runs, basins)
    assert plan(out).count("FileScan") == 1
    assert sorted((r["key"], r["run_status"]) for r in out.collect()) == [("B1_2025-01-05", "absent"), ("B2_2025-01-05_unscreened_10d", "absent")]


def test_bootstrap_blocks_stay_apart(spark):
    k = spark.range(500).select(F.col("id").alias("cluster"), (1 + F.col("id") % 7).alias("n"), (F.col("id") % 2).alias("tp"))
    out = evaluate.cluster_bootstrap(k, draws=64)
    # Partitions of a given number are not put together, whatever their size; steps are no structs in them.
    assert "REPARTITION_BY_NUM" in plan(out) and "MapInArrow" in plan(out)
    assert 0 < out.first()["ci_low"] < out.first()["ci_high"] < 1


def test_written_records_are_sorted_once(spark, tmp_path):
    df = spark.createDataFrame([(f"E{i}", "b", f'{{"n": {i}}}') for i in range(20)], "event_id string, basin string, t string")
    df = df.select("event_id", "basin", F.parse_json("t").alias("record"))
    for _ in range(2):
        records.write_records(df, df.select("event_id", F.lit("quotable").alias("status")), str(tmp_path / "r"))
    out = records.read_written(spark, str(tmp_path / "r"), df.schema)
    assert out.count() == 20 and plan(out).index("partial_max_by") < plan(out).index("Exchange")


def test_members_of_a_batch_are_found_once(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(persistence, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    files, target, checkpoint = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("feed", "positions", "cp"))
    for day in (1, 9):
        df = spark.createDataFrame([(f"c{day}{i}", day, 0.1 * i, 0.0, 1.0, ["p"]) for i in range(6)], "id string, day int, lon double, lat double, score double, source_pass_ids array<string>")
        # Written by several tasks, and one batch all the same.
        df.repartition(3).selectExpr("id", "date_add(date'2025-01-01', day) AS date", "lon", "lat", "score", "source_pass_ids").write.mode("append").parquet(files)
        persistence.start_position_persistence(spark.readStream.schema(persistence.CANDIDATE).parquet(files), target, checkpoint).awaitTermination()
    assert labels.count("members") == 2
    assert persistence.read_positions(spark, target).agg(F.sum("n_members")).first()[0] == 12
