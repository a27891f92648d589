"""Winds, infrastructure, metered truth, calibration and label sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.retrieval import wind_components

HOURLY_SCHEMA = (
    "hourly struct<time: array<string>, wind_speed_10m: array<double>, wind_direction_10m: array<double>>"
)
TRUTH_SCHEMA = (
    "campaigns array<struct<name: string, lat: double, lon: double, window_start: string, window_end: string, "
    "overpasses: array<struct<date: string, utc: string, kg_h: double, kind: string>>>>, "
    "detection_limit_note array<string>"
)

# Label vocabularies.
PASS1_VALUES = ["plume_like", "not_plume", "uncertain"]
PASS2_VALUES = ["real_plume", "artifact", "uncertain"]


def parse_hourly_winds(docs: DataFrame, text: str = "json") -> DataFrame:
    """Hourly rows from documents with parallel arrays; rows without a speed are dropped."""
    keep = [c for c in docs.columns if c != text]
    hours = docs.select(*keep, F.from_json(text, HOURLY_SCHEMA)["hourly"].alias("h")).select(
        *keep, F.explode(F.arrays_zip("h.time", "h.wind_speed_10m", "h.wind_direction_10m")).alias("x")
    )
    speed, direction = F.col("x.wind_speed_10m"), F.col("x.wind_direction_10m")
    u, v = wind_components(speed, direction)
    return hours.where(speed.isNotNull()).select(
        *keep, F.col("x.time").try_cast("timestamp").alias("time"), u.alias("u10"), v.alias("v10"),
        speed.alias("speed"), direction.alias("direction_from"),
    )


def union_layers(layers: dict[str, DataFrame | None]) -> DataFrame:
    """Facility layers stacked with their tag; absent layers are skipped, duplicates stay."""
    out = None
    for tag, df in layers.items():
        if df is None:
            continue
        missing = {"name", "type", "lat", "lon"} - set(df.columns)
        if missing:
            raise ValueError(f"layer {tag} lacks columns {sorted(missing)}")
        tagged = df.select(
            "name", "type", F.col("lat").cast("double"), F.col("lon").cast("double")
        ).withColumn("layer", F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no layer given")
    return out


def load_layers(spark: SparkSession, paths: dict[str, str | None]) -> DataFrame:
    return union_layers(
        {tag: spark.read.option("header", True).csv(p) if p else None for tag, p in paths.items()}
    )


def explode_truth(truth: DataFrame, campaign: str | None = None, kind: str | None = None) -> DataFrame:
    """Overpasses of nested campaigns, optionally of one campaign or kind."""
    c = truth.select(F.explode("campaigns").alias("c"))
    if campaign is not None:
        c = c.where(F.col("c.name") == campaign)
    rows = c.select(F.col("c.name").alias("campaign"), F.explode("c.overpasses").alias("o")).select("campaign", "o.*")
    return rows if kind is None else rows.where(F.col("kind") == kind)


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Curve table from JSON; an incomplete grid is an error. The table has tens of rows."""
    from ..operators.calibration import grid_completeness

    entries = spark.read.option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select(
        "e.satellite", "e.sza", "e.vza", "e.c1", "e.c2", "e.c3"
    )
    if not grid_completeness(entries).where(~F.col("complete")).isEmpty():
        raise ValueError(f"{path}: calibration grid is incomplete")
    return entries


def label_violations(labels: DataFrame) -> DataFrame:
    """Rows whose label is outside its vocabulary; missing labels are fine."""
    bad1 = ~F.col("pass1_morphology").isin(PASS1_VALUES)
    bad2 = ~F.col("pass2_final").isin(PASS2_VALUES)
    return labels.select(
        "*", F.coalesce(bad1, F.lit(False)).alias("bad_pass1"), F.coalesce(bad2, F.lit(False)).alias("bad_pass2")
    ).where(F.col("bad_pass1") | F.col("bad_pass2"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV with a header; a missing column is an error."""
    labels = spark.read.option("header", True).csv(path)
    missing = {"id", "pass1_morphology", "pass2_final"} - set(labels.columns)
    if missing:
        raise ValueError(f"labels lack columns {sorted(missing)}")
    return labels


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """``read_labels``, refusing labels outside their vocabulary."""
    labels = read_labels(spark, path)
    bad = label_violations(labels)
    if not bad.isEmpty():
        raise ValueError(f"invalid labels, first: {bad.first().asDict()}")
    return labels
