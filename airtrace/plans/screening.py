"""Queries for screening, stencils and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import background, stencil
from .registry import Tables, query, r6

PIXEL = ["stack_id", "row", "col"]

_WINDOWED = """
near AS (
  SELECT a.stack_id, a.frame, a.row, a.col, a.value, b.value AS other
  FROM px a LEFT JOIN px b ON a.stack_id = b.stack_id AND a.row = b.row AND a.col = b.col
   AND b.frame BETWEEN a.frame - 15 AND a.frame + 15 AND b.frame <> a.frame),
med AS (SELECT *, quantile_cont(other, 0.5) OVER (PARTITION BY stack_id, frame, row, col) AS median FROM near),
bg AS (SELECT stack_id, frame, row, col, any_value(value) AS value, any_value(median) AS median,
              quantile_cont(abs(other - median), 0.5) AS mad
       FROM med GROUP BY stack_id, frame, row, col)"""

_SCREEN = (
    "px AS (SELECT stack_id, frame, row, col, CASE WHEN qa >= 0.5 THEN value END AS value FROM v_pixels),"
    + _WINDOWED
    + """, scored AS (SELECT *, CASE WHEN mad >= 2 THEN 0.6745 * (value - median) / mad END AS z FROM bg)"""
)


@query(
    "screen_anomalies",
    """SELECT stack_id, frame, count(z) AS n_scored,
              count(CASE WHEN z >= 3 THEN 1 END) AS n_anomalous, round(max(z), 6) AS z_peak
       FROM scored GROUP BY stack_id, frame""",
    extra=_SCREEN,
)
def screen_anomalies(t: Tables):
    return background.screen_anomalies(t.v_pixels, PIXEL).groupBy("stack_id", "frame").agg(
        F.count("z").alias("n_scored"),
        F.count(F.when(F.col("anomalous"), 1)).alias("n_anomalous"),
        r6(F.max("z")).alias("z_peak"),
    )


@query(
    "rolling_background",
    "SELECT stack_id, frame, row, col, round(median, 6) AS median, round(mad, 6) AS mad FROM bg",
    extra="px AS (SELECT * FROM v_pixels)," + _WINDOWED,
)
def rolling_background(t: Tables):
    return background.rolling_background(t.v_pixels, PIXEL).select(
        "stack_id", "frame", "row", "col", r6("median").alias("median"), r6("mad").alias("mad")
    )


@query(
    "scene_normalize",
    """SELECT vec_id, round(sum(norm), 4) AS norm_sum, round(max(norm), 6) AS norm_max FROM (
         SELECT vec_id, least(greatest(x - (avg(x) OVER w - stddev_pop(x) OVER w), 0), 100) / 100 AS norm
         FROM (SELECT vec_id, 1800e0 + 200e0 * unnest(embedding) AS x FROM embeddings)
         WINDOW w AS (PARTITION BY vec_id)) GROUP BY vec_id""",
)
def scene_normalize(t: Tables):
    px = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", "pos", (F.col("x").cast("double") * 200.0 + 1800.0).alias("value")
    )
    return stencil.scene_normalize(px, ["vec_id"]).groupBy("vec_id").agg(
        r6(F.sum("norm"), 4).alias("norm_sum"), r6(F.max("norm")).alias("norm_max")
    )
