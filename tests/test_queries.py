"""Registered queries against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from airtrace.plans.views import BASE, VIEWS
from check import rows_of

SF = "/root/testdata/sf0.001"
FAST = """screen_anomalies rolling_background candidate_pairs match_events cluster_events persist_candidates infra_context
catalog_rate_lookup catalog_load extract_blobs source_component fill_small_holes plume_mask honesty_gates rate_monte_carlo
noise_scene_join atlas_summary pair_references background_lag_search agreement_study sensitivity_grid power_assessment
scene_features feature_table run_detector align_shift resample_shift stream_persistence stream_daily_screen stream_catalog_ingest
calibration_interp solar_zenith noise_key_parse winds_window_median cluster_bootstrap""".split()
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else FAST


def test_names_are_known():
    assert set(FAST) <= set(ORACLES) and set(ORACLES) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_views_use_no_row_filter():
    for text in VIEWS.values():
        assert " WHERE " not in text and " LIMIT " not in text
