"""Components, clustering, matching and delineation against plain Python."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

import naive
from airtrace.operators import components, delineate, greedy, matching, spatial

START = date(2025, 1, 1)


def random_masks(n, size, seed=0):
    rng = np.random.default_rng(seed)
    return {s: {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((size, size)) < rng.uniform(0.2, 0.65)))} for s in range(n)}


@pytest.mark.parametrize("eight,tile", [(False, 256), (False, 7), (True, 5)])
def test_pixel_components(spark, eight, tile):
    masks = random_masks(100, 18)
    rows = [(s, r, c) for s, m in masks.items() for r, c in m]
    df = spark.createDataFrame(rows, "s int, row int, col int")
    got = components.pixel_components(df, ["s"], eight, tile).collect()
    by_scene = {}
    for r in got:
        by_scene.setdefault(r["s"], {})[(r["row"], r["col"])] = (r["label"] >> 32, r["label"] & 0xFFFFFFFF)
    for s, m in masks.items():
        want = {}
        for g in naive.groups(m, eight):
            want.update({p: min(g) for p in g})
        assert _same_partition(by_scene.get(s, {}), want)


def _same_partition(a, b):
    if set(a) != set(b):
        return False
    return len(set(a.values())) == len(set(b.values())) == len({(a[p], b[p]) for p in a})


def test_labels_are_first_pixels_within_a_tile(spark):
    df = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (0, 1, 1), (0, 5, 5)], "s int, row int, col int")
    labels = {(r["row"], r["col"]): r["label"] for r in components.pixel_components(df, ["s"]).collect()}
    assert labels[(2, 1)] == labels[(1, 2)] == (1 << 32) + 1 and labels[(5, 5)] == (5 << 32) + 5


@pytest.mark.parametrize("parts", [1, 16])
def test_graph_components_long_chain(spark, parts):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(parts)
    out = components.graph_components(edges)
    assert out.count() == 201 and out.select("label").distinct().collect()[0][0] == 0


def random_events(n, seed, prefix, spread=1.2, days=30):
    rng = np.random.default_rng(seed)
    return [
        (f"{prefix}{i:04d}", naive.day(START, rng.integers(0, days)), float(10 + rng.uniform(0, spread)),
         float(40 + rng.uniform(0, spread)), float(rng.integers(0, 5)))
        for i in range(n)
    ]


EVENT = "id string, date date, lon double, lat double, score double"


def test_cluster_events_equals_sequential_walk(spark):
    rows = random_events(160, 3, "e")
    rows += [("copy", *rows[5][1:])]
    got = greedy.cluster_events(spark.createDataFrame(rows, EVENT), 25.0, 5, number=True).collect()
    want = naive.clusters([(i, d, x, y, 0.0) for i, d, x, y, _ in rows], 25.0, 5)
    assert _same_partition({r["id"]: r["cluster_id"] for r in got}, want)
    starts = {}
    for r in got:
        starts[r["cluster_id"]] = min(starts.get(r["cluster_id"], (r["date"], r["lon"], r["lat"])), (r["date"], r["lon"], r["lat"]))
    assert [starts[k] for k in sorted(starts)] == sorted(starts.values()) and min(starts) == 0


def test_persistence_equals_sequential_walk(spark):
    rows = random_events(120, 4, "c")
    df = spark.createDataFrame(rows, EVENT).withColumn("source_pass_ids", F.array(F.col("id")))
    got = {r["candidate_id"]: r for r in greedy.persist_candidates(df, 2, 3, 25.0).collect()}
    owner = naive.clusters([(i, d, x, y, -s) for i, d, x, y, s in rows], 25.0, 3)
    members = {}
    for r in rows:
        members.setdefault(owner[r[0]], []).append(r)
    assert set(got) == set(members)
    for a, rs in members.items():
        assert got[a]["confirmed"] == (len({r[1] for r in rs}) >= 2)
        assert got[a]["score"] == max(r[4] for r in rs)
        assert got[a]["source_pass_ids"] == sorted(r[0] for r in rs)


def test_matching_equals_sequential_choice(spark):
    det, ref = random_events(120, 5, "d", 0.8), random_events(100, 6, "r", 0.8)
    got = matching.match_events(spark.createDataFrame(det, EVENT), spark.createDataFrame(ref, EVENT))
    assert {r["ref_id"]: r["det_id"] for r in got.collect()} == naive.matches(det, ref, 25.0, 3)


def test_pairs_right_at_the_radius_are_reached(spark):
    """The last float east of a point whose haversine distance is within the radius, and the next one."""
    det, ref, want = [], [], set()
    for i in range(60):
        lat = -60.0 + 2 * i
        low, high = 0.0, 2.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if greedy.distance_km(0.0, lat, mid, lat) <= 25.0 else (low, mid)
        for name, lon in (("in", low), ("out", np.nextafter(high, 3))):
            det.append((f"{name}{i:02d}", naive.day(START, 40 * (name == "out")), float(lon), lat, 1.0))
            ref.append((f"r{name}{i:02d}", naive.day(START, 40 * (name == "out")), 0.0, lat, 1.0))
        want.add((f"rin{i:02d}", f"in{i:02d}"))
    frames = [spark.createDataFrame(x, EVENT) for x in (det, ref)]
    got = {(r["ref_id"], r["det_id"]) for r in matching.match_events(*frames).collect()}
    assert got == want
    both = frames[0].unionByName(frames[1]).where("not id like '%out%'")
    assert greedy.cluster_events(both).select("cluster_id").distinct().count() == 60


def test_match_crossing_pairs_and_window_miss(spark):
    det = [("d1", START, 10.0, 40.0, 1.0), ("d2", START, 10.1, 40.0, 1.0), ("d3", naive.day(START, 9), 10.0, 40.0, 1.0)]
    ref = [("r1", START, 10.09, 40.0, 1.0), ("r2", START, 10.01, 40.0, 1.0)]
    m = matching.match_events(spark.createDataFrame(det, EVENT), spark.createDataFrame(ref, EVENT))
    assert {r["ref_id"]: r["det_id"] for r in m.collect()} == {"r1": "d2", "r2": "d1"}
    left = matching.unmatched(spark.createDataFrame(det, EVENT), m, "det").collect()
    assert [r["id"] for r in left] == ["d3"]


def test_candidate_pairs_over_pole_dateline_and_hot_buckets(spark):
    rng = np.random.default_rng(7)
    spots = [(179.95, 10.0), (-179.95, 10.05), (0.0, 89.95), (170.0, 89.9), (5.0, 5.0)]
    rows = [
        (f"p{i}", naive.day(START, rng.integers(0, 6)), s[0] + float(rng.uniform(-0.05, 0.05)) % 360, s[1] + float(rng.uniform(-0.05, 0.05)), 1.0)
        for i, s in enumerate(spots * 12)
    ]
    rows = [(i, d, x if x <= 180 else x - 360, y, s) for i, d, x, y, s in rows]
    df = spark.createDataFrame(rows, EVENT)
    want = {(a[0], b[0]) for a in rows for b in rows if naive.km(a[2:4], b[2:4]) <= 25 and abs((a[1] - b[1]).days) <= 2}
    for hot in (1_000_000, 3):
        got = spatial.candidate_pairs(df, df, 25.0, 2, hot_rows=hot).select("ref_id", "det_id").collect()
        assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want


def test_a_hot_right_side_alone_is_cut(spark):
    """Three detections meet a bucket of 600 references: every pair once, and for left joins every left row once."""
    rng = np.random.default_rng(8)
    det = [(f"d{i}", START, 10.0 + i / 100, 5.0, 1.0) for i in range(3)] + [("far", START, 90.0, 5.0, 1.0)]
    ref = [(f"r{i}", START, 10.0 + float(rng.uniform(0, 0.05)), 5.0 + float(rng.uniform(0, 0.05)), 1.0) for i in range(600)]
    left, right = spark.createDataFrame(det, EVENT), spark.createDataFrame(ref, EVENT)
    pairs = spatial.candidate_pairs(left, right, 25.0, 2, hot_rows=100)
    assert sorted(tuple(r) for r in pairs.select("det_id", "ref_id").collect()) == sorted((d[0], r[0]) for d in det[:3] for r in ref)
    plan = pairs._jdf.queryExecution().toString()
    assert "_rsalt" in plan and "CartesianProduct" not in plan
    right = right.select(F.col("id").alias("f_id"), F.col("lon").alias("f_lon"), F.col("lat").alias("f_lat"))
    axes = spatial._space_axes(25.0, "lon", "lat", "f_lon", "f_lat")
    near = F.expr("abs(lon - f_lon) < 1")
    for how, want in (("left", 1801), ("left_semi", 3), ("left_anti", 1)):
        assert spatial.bucket_join(left, right, axes, near, how, hot_rows=100).count() == want


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_no_side_of_a_range_join_is_broadcast(spark, how):
    """Sides look small by their files and are copied to several buckets; only the table of hot buckets is broadcast."""
    left = spark.range(10).select(F.col("id").alias("a"), (F.col("id") * 0.1).alias("lon"), F.lit(0.0).alias("lat"))
    right = left.select(F.col("a").alias("b"), F.col("lon").alias("f_lon"), F.col("lat").alias("f_lat"))
    joined = spatial.within_radius(left, right, 25.0, how)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    broadcast = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert "SortMergeJoin" in plan and all("LeftOuter" in line for line in broadcast)
    assert joined.count() == (10 + 2 * 9 + 2 * 8 if how == "inner" else 10)


def test_catalog_lookup_does_not_sort_pairs(spark):
    """Nearest date first, then the smallest id as text; pairs are combined by hashing."""
    ev = spark.createDataFrame([("e1", START, 10.0, 40.0), ("e2", START, 50.0, 0.0)], "id string, date date, lon double, lat double")
    rows = [("c9", 1, 1.5), ("c10", 1, 2.5), ("c1", 2, 3.5), ("c0", 0, None)]
    cat = spark.createDataFrame([(i, naive.day(START, d), 10.1, 40.1, v) for i, d, v in rows], "id string, date date, lon double, lat double, rate_t_h double")
    out = spatial.catalog_rate_lookup(ev, cat)
    assert {tuple(r) for r in out.select("id", "catalog_id", "dt_days", "catalog_t_h").collect()} == {("e1", "c10", 1, 2.5), ("e2", None, None, None)}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_cross_product_in_pair_plans(spark):
    df = spark.createDataFrame(random_events(30, 8, "e"), EVENT)
    plan = spatial.candidate_pairs(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("tile", [256])
def test_delineation_equals_plain_rules(spark, tile):
    rng = np.random.default_rng(11)
    size, rows, scenes, want = 24, [], [], {}
    for s in range(12):
        noise = rng.normal(0, 1, (size, size))
        smooth = sum(np.roll(np.roll(noise, a, 0), b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 3
        mask = {(int(r), int(c)) for r, c in zip(*np.nonzero(smooth > -0.35))}
        vals = {(r, c): float(rng.uniform(-150, 3700)) if rng.random() < 0.1 else float(rng.uniform(50, 900)) for r in range(size) for c in range(size)}
        valid = {p: bool(rng.random() < 0.97) for p in vals}
        src = (float(rng.uniform(0, size)), float(rng.uniform(0, size)))
        wind = (float(rng.uniform(-3, 3)), float(rng.uniform(0.2, 3)))
        rows += [(s, r, c, v, (r, c) in mask, valid[(r, c)]) for (r, c), v in vals.items()]
        scenes.append((s, *src, *wind, size, size))
        want[s] = naive.delineate(vals, mask, valid, src, wind, size)
    px = spark.createDataFrame(rows, "s int, row int, col int, value double, in_mask boolean, valid boolean")
    sc = spark.createDataFrame(scenes, "s int, src_row double, src_col double, u double, v double, n_rows int, n_cols int")
    kept, ledger = delineate.delineate_plume(px, sc, ["s"])
    got = {}
    for r in kept.collect():
        got.setdefault(r["s"], set()).add((r["row"], r["col"]))
    steps = {}
    for r in ledger.orderBy("s", "ord").collect():
        steps.setdefault(r["s"], []).append(r["n_after"])
        assert r["n_before"] - r["dropped_px"] + r["added_px"] == r["n_after"]
    for s, (m, counts) in want.items():
        assert got.get(s, set()) == m
        assert steps[s] == counts
    report = delineate.delineation_report(ledger, ["s"]).collect()
    assert len(report) == 12 and all(r["balanced"] for r in report)


def test_delineation_skips_rules_without_inputs(spark):
    px = spark.createDataFrame([(0, r, c, 100.0, True) for r in range(6) for c in range(6)], "s int, row int, col int, value double, in_mask boolean")
    sc = spark.createDataFrame([(0, None, None, None, None)], "s int, src_row double, src_col double, u double, v double")
    kept, ledger = delineate.delineate_plume(px, sc, ["s"])
    status = {r["rule"]: r["status"] for r in ledger.collect()}
    assert kept.count() == 36 and "invalid" not in status
    assert {k for k, v in status.items() if v == "skipped"} == {"source_connectivity", "downwind_sector", "distance_bound"}
    assert "reconnect" not in status
    bare, off = delineate.delineate_plume(px.drop("value"), sc, ["s"], disabled=frozenset({"morphology", "source_connectivity", "downwind_sector", "distance_bound"}))
    rows = {r["rule"]: (r["status"], r["note"], r["n_before"], r["n_after"]) for r in off.collect()}
    assert rows == {r: ("skipped", "no enhancement field supplied" if r == "amplitude" else "disabled by caller", 36, 36) for r in delineate.RULES if r not in ("invalid", "reconnect")}
    assert bare.count() == 36


def test_holes_cost_the_border_and_not_the_box(spark):
    """Two far pixels of a full scene, a wide gap, and random masks with holes."""
    far = spark.createDataFrame([(0, 0, 0), (0, 10_979, 10_979), (1, 5, 0), (1, 5, 10_979)], "s int, row int, col int")
    assert components.row_gaps(far, ["s"], 25).count() == 0
    assert components.fill_holes(far, ["s"]).count() == 4
    rng = np.random.default_rng(4)
    masks = {s: {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((14, 17)) < 0.45 + s / 40))} for s in range(14)}
    got = components.fill_holes(spark.createDataFrame([(s, *p) for s, m in masks.items() for p in m], "s int, row int, col int"), ["s"], 3).collect()
    want = {(s, *p) for s, m in masks.items() for p in naive.fill(m, 3)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > sum(map(len, masks.values()))
