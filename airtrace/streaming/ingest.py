"""Catalog ingest as a stream: drift guard, canonical rows, duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import check_drift


def first_copies(batch: DataFrame, id_col: str) -> DataFrame:
    """One row per id. Rows are dealt out by id first: else a task sorts all rows of the file that it reads, whatever the file's size."""
    return batch.repartition(id_col).dropDuplicates([id_col])


def start_ingest(
    stream: DataFrame, target: str, checkpoint: str, source: str, manifest: str, id_col: str = "id", allow_new_schema: bool = False
):
    """Append the first copy of every id batch by batch; an unacknowledged schema change stops the stream.

    Ids are compared with those stored by earlier batches, however old, so late
    rows are kept and copies are not. Each batch writes its own folder,
    overwritten on replay, so a retried batch is not doubled.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        check_drift(batch, source, manifest, allow_new_schema)
        fresh = first_copies(batch, id_col)
        if batch_id:
            schema = batch.select(id_col).schema.add("batch", "long")
            stored = batch.sparkSession.read.schema(schema).parquet(target).where(F.col("batch") < batch_id)
            fresh = fresh.join(stored.select(id_col), id_col, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_daily_screen(stream: DataFrame, target: str, checkpoint: str, time_col: str = "ts", key: str = "basin"):
    """Anomalous pixels per key and day with their count and peak, as subtotals of every batch.

    A subtotal is final when its batch ends, so the stream holds no state and no
    watermark drops late rows: they are subtotals of a later batch, merged with
    the others when the screen is read. Each batch writes its own folder, overwritten on replay.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date(time_col).alias("day")
        batch.groupBy(key, day).agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("z_peak")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_daily_screen(spark: SparkSession, target: str, key: str = "basin") -> DataFrame:
    """The screen so far: subtotals merged by key and day."""
    parts = spark.read.schema(f"`{key}` string, day date, n bigint, z_peak double").parquet(target)
    return parts.groupBy(key, "day").agg(F.sum("n").alias("n"), F.max("z_peak").alias("z_peak"))
