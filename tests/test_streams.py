"""Streams whose result equals the batch operator, with bounded state."""

import random
import uuid

import naive
from pyspark.sql import functions as F
from test_graph import START

from airtrace.operators import greedy
from airtrace.session import shared_dir
from airtrace.streaming import ingest, persistence


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def feed(spark, frames, schema):
    files = folder(spark, "feed")
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(files)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)


def test_persistence_by_place_equals_the_batch_and_lets_go_of_history(spark):
    rng = random.Random(4)
    rows = [(f"c{i:03d}", naive.day(START, i // 5), rng.uniform(0, 1.5), rng.uniform(0, 1.5), rng.random(), [f"p{i}"]) for i in range(200)]
    parts = [[] for _ in range(5)]
    for i, r in enumerate(rows):
        parts[min(4, i // 40 + (i % 7 == 0))].append(r)
    too_late = ("late", naive.day(START, 1), 0.7, 0.7, 1.0, ["x"])
    frames = [spark.createDataFrame(p + [too_late] * (k == 4), persistence.CANDIDATE) for k, p in enumerate(parts)]
    target = folder(spark, "positions")
    persistence.start_position_persistence(feed(spark, frames, persistence.CANDIDATE), target, folder(spark, "cp"), late_days=8).awaitTermination()
    columns = ["candidate_id", "det_date", "n_members", "n_dates", "score", "confirmed", "source_pass_ids"]
    got = sorted(tuple(r) for r in persistence.read_positions(spark, target).select(*columns).collect())
    batch = greedy.persist_candidates(spark.createDataFrame(rows, persistence.CANDIDATE))
    assert got == sorted(tuple(r) for r in batch.select(*columns).collect()) and len(got) > 20
    state = spark.read.schema(persistence.CANDIDATE + ", b long").parquet(f"{target}/state")
    assert state.agg(F.min("b")).first()[0] >= 3 and 0 < state.where("b = 4").count() < 120
    assert [r["id"] for r in spark.read.schema(persistence.CANDIDATE).parquet(f"{target}/late").collect()] == ["late"]


def test_daily_screen_keeps_late_rows(spark):
    rows = [(f"2025-01-0{1 + i % 4} 0{i % 10}:00:00", "ab"[i % 2], float(i)) for i in range(60)]
    schema = "ts string, basin string, z double"
    frames = [spark.createDataFrame(rows[k::3], schema).withColumn("ts", F.to_timestamp("ts")) for k in range(3)]
    target = folder(spark, "daily")
    ingest.start_daily_screen(feed(spark, frames, frames[0].schema), target, folder(spark, "cp")).awaitTermination()
    got = {(r["basin"], str(r["day"])): (r["n"], r["z_peak"]) for r in ingest.read_daily_screen(spark, target).collect()}
    want = {}
    for ts, b, z in rows:
        n, top = want.get((b, ts[:10]), (0, z))
        want[b, ts[:10]] = (n + 1, max(top, z))
    assert got == want
