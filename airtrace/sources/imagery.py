"""Image collections: the first image of a day and region exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_first_image(obs: DataFrame, key: list[str], bbox: tuple | None = None) -> DataFrame:
    """Pixels of the earliest image of each day and key, clipped to a closed row/column box.

    The choice is a map-side minimum over image ids; pixels are only filtered.
    """
    first = obs.groupBy(*key, "day").agg(F.min("image").alias("image"))
    out = obs.join(first, [*key, "day", "image"], "left_semi")
    if bbox is not None:
        r0, c0, r1, c1 = bbox
        out = out.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return out


def export_pixels(pixels: DataFrame, target: str) -> None:
    """Write screening pixels laid out for pruning by stack and month."""
    pixels.withColumn("obs_month", F.date_format("obs_date", "yyyy-MM")).repartition(
        "stack_id", "obs_month"
    ).sortWithinPartitions("row", "col").write.mode("append").partitionBy("stack_id", "obs_month").parquet(target)
