"""Event catalogs: alias resolution, parsing, snapshots and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_bbox
from ..functions.numeric import finite
from ..operators.ranking import row_numbers

# Accepted column names, first match wins.
ALIASES = {
    "id": ["id", "plume_id", "detection_id"],
    "date": ["date", "observation_date", "time", "day"],
    "lon": ["lon", "longitude", "lon_deg"],
    "lat": ["lat", "latitude", "lat_deg"],
    "rate_t_h": ["rate_t_h", "source_rate_t/h", "flux", "emission_rate", "ch4_flux"],
}
PASSTHROUGH = ["source_country", "source_type", "uncertainty_t/h"]
SOURCE_NAME = "sron_weekly"
ID_FORMAT = "sron-%05d"


def parse_day(text: Column) -> Column:
    """YYYYMMDD (a trailing .0 is ignored) or ISO; anything else is NULL."""
    t = F.regexp_replace(F.trim(text), r"\.0$", "")
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("date"))
    return F.coalesce(compact, t.try_cast("date"))


def canonical_events(raw: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Catalog rows in canonical form. ``order`` gives the row position used for generated ids."""
    found = {}
    for name, names in ALIASES.items():
        hit = next((a for a in names if a in raw.columns), None)
        if hit:
            found[name] = F.col(f"`{hit}`").cast("string")
    missing = {"date", "lon", "lat"} - set(found)
    if missing:
        raise ValueError(f"catalog lacks required columns {sorted(missing)}")
    number = {k: finite(found[k].try_cast("double")) for k in ("lon", "lat")}
    rate = finite(found["rate_t_h"].try_cast("double")) if "rate_t_h" in found else F.lit(None).cast("double")
    extras = [F.col(f"`{c}`") for c in PASSTHROUGH if c in raw.columns]
    order_cols = [c.alias(f"_o{i}") for i, c in enumerate(order or [])]
    ids = [found["id"].alias("id")] if "id" in found else []
    out = raw.select(
        *ids, parse_day(found["date"]).alias("date"), number["lon"].alias("lon"), number["lat"].alias("lat"),
        rate.alias("rate_t_h"), F.lit(SOURCE_NAME).alias("source"), *extras, *order_cols,
    ).dropna(subset=["date", "lon", "lat"])
    if "id" not in found:
        if not order:
            raise ValueError("a catalog without ids needs a row order")
        keys = [F.col(f"_o{i}") for i in range(len(order))]
        out = row_numbers(out, keys, "_pos").withColumn("id", F.format_string(ID_FORMAT, F.col("_pos") - 1))
    kept = ["id", "date", "lon", "lat", "rate_t_h", "source"]
    return out.select(*kept, *[F.col(f"`{c}`") for c in PASSTHROUGH if c in raw.columns])


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read catalog CSV files as text and canonicalise them in file order."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_line", F.monotonically_increasing_id())
    return canonical_events(raw, [F.col("_file"), F.col("_line")])


def filter_events(events: DataFrame, bbox=None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Closed box and closed day range; each bound is optional."""
    if bbox is not None:
        events = events.where(in_bbox("lon", "lat", *[float(b) for b in bbox]))
    if start is not None:
        events = events.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        events = events.where(F.col("date") <= F.lit(end).cast("date"))
    return events


def newest_snapshot(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows of the file that sorts last by path."""
    last = files.agg(F.max(path).alias(path))
    return files.join(F.broadcast(last), path, "left_semi")
