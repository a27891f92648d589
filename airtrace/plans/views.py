"""Domain tables derived from the given Parquet tables.

Each view is one SELECT that Spark SQL and DuckDB both read. Every view covers
its whole base tables and grows with them; ``%`` only derives attributes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SITE_LON = "(-170e0 + (({k} * 7919) % 34000) / 1e2)"
SITE_LAT = "(-60e0 + (({k} * 10473) % 12000) / 1e2)"


def _site(key: str) -> tuple[str, str]:
    return SITE_LON.format(k=key), SITE_LAT.format(k=key)


_LON, _LAT = _site("o_custkey")
_FLON, _FLAT = _site("(p_partkey - p_partkey % 8)")
_SLON, _SLAT = _site("s_suppkey")

VIEWS: dict[str, str] = {
    # Daily stacks: one stack per ten suppliers, 16x16 cells, monthly frames with gaps.
    "v_pixels": """
        SELECT cast((l_suppkey - l_suppkey % 10) / 10 AS int) AS stack_id,
               cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS int) AS frame,
               cast(l_partkey % 16 AS int) AS row, cast(l_orderkey % 16 AS int) AS col,
               min(l_extendedprice) / 1e2 AS value, max(1e0 - l_discount * 8) AS qa
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "v_detections": f"""
        SELECT concat('d', lpad(cast(o_orderkey AS varchar(20)), 12, '0')) AS id,
               DATE '2025-01-01' + cast((o_orderkey * 13) % 40 AS int) AS date,
               {_LON} + ((o_orderkey * 7) % 50) / 1e2 AS lon,
               {_LAT} + ((o_orderkey * 11) % 40) / 1e2 AS lat,
               o_totalprice / 1e3 AS score
        FROM orders""",
    "v_reference": f"""
        SELECT concat('r', lpad(cast(o_orderkey AS varchar(20)), 12, '0')) AS id,
               DATE '2025-01-01' + cast((o_orderkey * 17) % 40 AS int) AS date,
               {_LON} + ((o_orderkey * 3) % 50) / 1e2 AS lon,
               {_LAT} + ((o_orderkey * 19) % 40) / 1e2 AS lat,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 5e3 END AS rate_t_h,
               o_orderstatus AS status
        FROM orders""",
    "v_facilities": f"""
        SELECT p_name AS kind_name, concat('F', cast(p_partkey AS varchar(20))) AS name,
               CASE p_partkey % 3 WHEN 0 THEN 'well' WHEN 1 THEN 'pad' ELSE 'compressor' END AS type,
               CASE WHEN p_partkey % 2 = 0 THEN 'gem' ELSE 'osm' END AS layer,
               {_FLON} + ((p_partkey * 3) % 20) / 1e2 AS lon, {_FLAT} + ((p_partkey * 7) % 20) / 1e2 AS lat
        FROM part
        UNION ALL
        SELECT s_name, concat('S', cast(s_suppkey AS varchar(20))), 'well', 'flight',
               {_SLON} + 2e-1, {_SLAT} + 1e-1
        FROM supplier""",
    "v_winds": """
        SELECT event_id, user_id AS site, ts AS time, 5e-1 + event_id % 12 AS speed,
               cast((event_id * 37) % 360 AS double) AS direction_from
        FROM events""",
    # Band pixels: pass 0 of each ten is the target, the others are references.
    "v_bands": """
        SELECT cast((l_suppkey - l_suppkey % 10) / 10 AS int) AS target_id,
               cast(l_suppkey % 10 AS int) AS pass_id,
               cast(l_partkey % 16 AS int) AS row, cast(l_orderkey % 16 AS int) AS col,
               max(l_extendedprice) AS b11, max(l_quantity) * 1e3 AS b12,
               min(l_discount) < 9e-2 AS valid, max(l_tax) < 8e-2 AS clear
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    # Retrieval scenes: one per supplier.
    "v_scene": """
        SELECT cast(l_suppkey AS int) AS scene_id,
               cast(l_partkey % 16 AS int) AS row, cast(l_orderkey % 16 AS int) AS col,
               max(l_extendedprice) / 5e1 - 1e3 AS value,
               max(l_quantity) >= 41 AS in_mask, max(l_quantity) >= 49 AS core,
               min(l_discount) < 9e-2 AS valid, max(l_quantity) / 5e1 AS plume_score
        FROM lineitem GROUP BY 1, 2, 3""",
    "v_passes": """
        SELECT o_orderkey AS pass_key,
               concat(CASE o_orderkey % 2 WHEN 0 THEN 'S2A' ELSE 'S2B' END, '_MSIL1C_',
                      CASE WHEN o_orderkey % 9 = 0 THEN 'nodate'
                           ELSE concat('2024', lpad(cast(1 + o_orderkey % 12 AS varchar(2)), 2, '0'),
                                lpad(cast(1 + o_orderkey % 28 AS varchar(2)), 2, '0'), 'T101031') END,
                      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('_R0', cast(10 + o_orderkey % 3 AS varchar(2))) END,
                      '_T40TFK_', cast(o_orderkey AS varchar(20))) AS scene,
               o_custkey AS event,
               cast((o_orderkey * 7) % 33 AS int) - 16 AS dt_days,
               (cast(floor(o_totalprice) AS bigint) % 8) / 1e2 AS cloud,
               92e-2 + ((cast(floor(o_totalprice) AS bigint) * 3) % 8) / 1e2 AS corr,
               ((cast(floor(o_totalprice) AS bigint) * 7) % 40) / 1e1 AS mbsp,
               ((cast(floor(o_totalprice) AS bigint) * 13) % 5) / 1e2 AS nodata
        FROM orders""",
    # Run records; a campaign is a customer.
    "v_runs": """
        SELECT concat('EVT-', cast(o_orderkey AS varchar(20))) AS event_id, o_orderkey AS run_key,
               concat('C', cast(o_custkey AS varchar(20))) AS campaign,
               CASE o_custkey % 3 WHEN 0 THEN 'korpezhe' WHEN 1 THEN 'permian' ELSE 'region_c' END AS basin,
               DATE '2025-01-01' + cast((o_orderkey * 13) % 40 AS int) AS det_date,
               CASE WHEN o_orderkey % 17 = 0 THEN 'diagnostic' ELSE o_orderstatus END AS result_status,
               o_orderkey % 11 = 0 AS superseded, o_orderkey % 13 = 0 AS do_not_quote,
               cast(o_orderkey % 400 AS int) + 1 AS npix, o_totalprice AS q_kg_h,
               o_orderstatus = 'F' AS withheld, o_orderkey % 7 <> 0 AS readable,
               o_orderkey % 4 <> 0 AS is_plume,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1e0 + (o_orderkey % 90) / 1e1 END AS u10
        FROM orders""",
    "v_truth": """
        SELECT concat('C', cast(o_custkey AS varchar(20))) AS campaign,
               DATE '2025-01-01' + cast((o_orderkey * 13) % 40 AS int) AS date,
               CASE o_orderkey % 4 WHEN 0 THEN 'zero_control' WHEN 3 THEN 'no_release' ELSE 'release' END AS kind,
               CASE WHEN o_orderkey % 4 IN (0, 3) THEN 0e0 ELSE floor(o_totalprice) / 1e1 END AS kg_h,
               o_orderkey AS overpass_key
        FROM orders""",
    "v_calibration": """
        SELECT CASE l_suppkey % 2 WHEN 0 THEN 'S2A' ELSE 'S2B' END AS satellite,
               cast(10 * (l_linenumber) AS double) AS sza,
               cast(5 * (l_partkey % 3) AS double) AS vza,
               2e4 + max(l_quantity) * 1e2 + count(*) % 100 AS c1,
               1e5 + count(*) % 1000 AS c2, 1e4 + max(l_orderkey) % 1000 AS c3
        FROM lineitem GROUP BY 1, 2, 3""",
    "v_basins": """
        SELECT 'korpezhe' AS basin, 'champion' AS role, 58e0 AS lon_min, 385e-1 AS lat_min, 60e0 AS lon_max,
               40e0 AS lat_max, 'homogeneous_arid' AS surface_class, 1013e0 AS pressure
        UNION ALL SELECT 'permian', 'champion', -1035e-1, 31e0, -1015e-1, 33e0, 'heterogeneous', 950e0
        UNION ALL SELECT 'region_c', 'coverage', 4e0, 30e0, 8e0, 335e-1, 'heterogeneous', 1000e0""",
    # Events moved into the basins so that every basin has members.
    "v_basin_events": """
        SELECT o_orderkey AS event_key, concat('b', cast(o_orderkey AS varchar(20))) AS id,
               DATE '2025-01-01' + cast((o_orderkey * 13) % 300 AS int) AS date,
               CASE o_custkey % 4 WHEN 0 THEN 58e0 + ((o_custkey * 31) % 220) / 1e2
                                  WHEN 1 THEN -1035e-1 + ((o_custkey * 37) % 220) / 1e2
                                  WHEN 2 THEN 4e0 + ((o_custkey * 41) % 420) / 1e2 ELSE 100e0 END AS lon,
               CASE o_custkey % 4 WHEN 0 THEN 385e-1 + ((o_custkey * 43) % 160) / 1e2
                                  WHEN 1 THEN 31e0 + ((o_custkey * 47) % 220) / 1e2
                                  WHEN 2 THEN 30e0 + ((o_custkey * 53) % 360) / 1e2 ELSE 10e0 END AS lat,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 5e3 END AS rate_t_h,
               cast(month(o_orderdate) AS int) AS month
        FROM orders""",
    # Scene metadata with angles in JSON, one per order.
    "v_geometry": """
        SELECT o_orderkey AS scene_key,
               CASE o_orderkey % 3 WHEN 0 THEN 'S2A' WHEN 1 THEN 'S2B' ELSE 'S2C' END AS satellite,
               5e0 + (o_orderkey % 90) AS sza, (o_orderkey % 14) * 1e0 AS vza,
               ((o_orderkey * 7) % 2001 - 1000) / 1e4 AS log_ratio
        FROM orders""",
    # Two raters per document with a quality label.
    "v_labels": """
        SELECT doc_id AS id,
               CASE quality WHEN 1 THEN 'plume_like' ELSE 'not_plume' END AS pass1,
               CASE WHEN quality = 1 AND toxic = 0 THEN 'real_plume' WHEN toxic = 1 THEN 'artifact'
                    ELSE 'uncertain' END AS pass2,
               CASE quality WHEN 1 THEN 'real_plume' ELSE 'artifact' END AS rater_a,
               CASE toxic WHEN 1 THEN 'artifact' ELSE 'real_plume' END AS rater_b,
               doc_id % 9 = 0 AS is_control, cast(doc_id % 5 AS int) AS batch
        FROM labels""",
}

VIEWS["v_noise_runs"] = """
        SELECT o_orderkey AS run_key, concat('RUN-', lpad(cast(o_orderkey AS varchar(20)), 12, '0')) AS event_id,
               concat('C', cast(o_custkey AS varchar(20))) AS basin,
               DATE '2025-01-01' + cast((o_orderkey * 13) % 40 AS int) AS det_date,
               CASE WHEN o_orderkey % 11 = 0 THEN 'withdrawn' WHEN o_orderkey % 17 = 0 THEN 'diagnostic' ELSE 'quotable' END AS status,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE -60e0 + o_custkey % 120 END AS lat,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE -170e0 + o_custkey % 340 END AS lon,
               CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0e0 ELSE 1e0 + (o_orderkey % 90) / 1e1 END AS u10_ms,
               o_orderkey % 2 = 0 AS cloud_screening,
               CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE 'S2A_MSIL1C_20250115T101031_N1' END AS target_scene,
               CASE o_orderkey % 3 WHEN 0 THEN 'S2A_MSIL1C_20250105T101031_N1' WHEN 1 THEN 'S2A_MSIL1C_20241226T101031_N1'
                    ELSE 'S2A_MSIL1C_20241216T101031_N1' END AS background_scene,
               1e-3 + (o_orderkey % 60) / 1e3 AS sigma
        FROM orders"""
VIEWS["v_noise_keys"] = """
        SELECT key, min(sigma) AS sigma FROM (
          SELECT concat('C', cast(o_custkey AS varchar(20)), '_', cast(DATE '2025-01-01' + cast((o_orderkey * 13) % 40 AS int) AS varchar(10)),
                   CASE o_orderkey % 5 WHEN 0 THEN '_cloudscreened' WHEN 1 THEN '_unscreened' ELSE '' END,
                   CASE o_orderkey % 4 WHEN 0 THEN '_10d' WHEN 1 THEN '_20d' ELSE '' END) AS key,
                 1e-3 + (o_orderkey % 60) / 1e3 AS sigma
          FROM orders) k GROUP BY key"""
VIEWS["v_noise_basins"] = """
        SELECT concat('C', cast(c_custkey AS varchar(20))) AS basin,
               -170e0 + c_custkey % 330 AS lon_min, -168e0 + c_custkey % 330 AS lon_max,
               -60e0 + c_custkey % 115 AS lat_min, -58e0 + c_custkey % 115 AS lat_max,
               CASE WHEN c_nationkey % 2 = 0 THEN 'homogeneous_arid' ELSE 'heterogeneous' END AS surface_class,
               900e0 + c_nationkey * 4 AS pressure
        FROM customer"""

_DEPENDS = re.compile(r"\b(v_[a-z_]+)\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    text = VIEWS[name]
    used = [t for t in BASE if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(body: str, recursive: bool = False, extra: str = "") -> str:
    """DuckDB text with the views the body mentions spelled out in front."""
    names = sorted(set(_DEPENDS.findall(body + extra)) & set(VIEWS))
    ctes = [f"{n} AS ({VIEWS[n]})" for n in names]
    if extra:
        ctes.append(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body
