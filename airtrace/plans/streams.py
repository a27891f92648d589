"""Queries that replay the event table as a stream and return the sink's content."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import ingest, persistence
from .registry import Tables, query, r6
from .relations import PERSIST_EXTRA, PERSIST_SQL, candidate_columns, candidates


def _events(t: Tables):
    """The event file as a file-source stream with session-zone timestamps."""
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "stream_catalog_ingest",
    "SELECT event_type, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1",
)
def stream_catalog_ingest(t: Tables):
    target, manifest, files = _folder(t, "ingest"), _folder(t, "manifest"), _folder(t, "files")
    # Four files, each over the whole time range, so that three of them are late; every row arrives twice.
    t.events.repartition(4, F.col("event_id") % 4).write.parquet(files)
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(files)
    twice = stream.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("id", F.col("event_id").cast("string"))
    ingest.start_ingest(twice.drop("_copy"), target, _folder(t, "cp"), "events", manifest).awaitTermination()
    back = t.spark.read.schema("event_type string, value double").parquet(target)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.max("value")).alias("top"))


@query(
    "stream_daily_screen",
    """SELECT event_type AS basin, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(max(value), 6) AS z_peak FROM events
       WHERE value >= 60 GROUP BY 1, 2""",
)
def stream_daily_screen(t: Tables):
    target, files = _folder(t, "daily"), _folder(t, "files")
    # Three files, each over the whole time range, so that two of them are late.
    t.events.repartition(3, F.col("event_id") % 3).write.parquet(files)
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(files)
    hot = stream.where("value >= 60").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("basin"), F.col("value").alias("z"))
    ingest.start_daily_screen(hot, target, _folder(t, "cp")).awaitTermination()
    back = ingest.read_daily_screen(t.spark, target)
    return back.select("basin", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", r6("z_peak").alias("z_peak"))


@query("stream_position_persistence", PERSIST_SQL, recursive=True, extra=PERSIST_EXTRA)
def stream_position_persistence(t: Tables):
    """The candidates land in four parts by day, a tenth of each a part late; the stream runs after every part."""
    target, files, checkpoint = _folder(t, "positions"), _folder(t, "files"), _folder(t, "cp")
    late = F.when(F.crc32("id") % 10 == 0, 1).otherwise(0)
    part = F.least(F.floor(F.datediff("date", F.lit("2025-01-01")) / 10) + late, F.lit(3)).cast("int")
    stream = t.spark.readStream.schema(persistence.CANDIDATE).parquet
    for k in range(4):
        candidates(t).where(part == k).select(*[c.split(" ")[0] for c in persistence.CANDIDATE.split(", ")]).write.mode("append").parquet(files)
        # A run takes all files that are new as one batch, so a part may be written by any number of tasks.
        persistence.start_position_persistence(stream(files), target, checkpoint).awaitTermination()
    return candidate_columns(persistence.read_positions(t.spark, target))


@query(
    "stream_persistence",
    """SELECT source, anchor_day, n_dates, n_dates >= 2 AS confirmed FROM (
         SELECT u AS source, anchor AS anchor_day, count(*)::int AS n_dates FROM w WHERE anchor IS NOT NULL GROUP BY 1, 2)""",
    recursive=True,
    extra="""d AS (SELECT u, day, row_number() OVER (PARTITION BY u ORDER BY day) AS k FROM (
        SELECT DISTINCT cast(user_id AS varchar) AS u, date_diff('day', DATE '1970-01-01', cast(ts AS date))::int AS day FROM events)),
      w(u, k, anchor) AS (SELECT u, k, day FROM d WHERE k = 1
        UNION ALL SELECT d.u, d.k, CASE WHEN d.day - w.anchor <= 3 THEN w.anchor ELSE d.day END FROM w JOIN d ON d.u = w.u AND d.k = w.k + 1)""",
)
def stream_persistence(t: Tables):
    target = _folder(t, "persist")

    def sink(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/b={batch_id}")

    src = _events(t).select(F.col("user_id").cast("string").alias("source"), "ts")
    (
        persistence.persist_stream(src).writeStream.outputMode("update").foreachBatch(sink)
        .option("checkpointLocation", _folder(t, "cp")).trigger(availableNow=True).start().awaitTermination()
    )
    schema = "source string, anchor_day int, n_dates int, confirmed boolean, final boolean, batch bigint"
    return persistence.latest(t.spark.read.schema(schema).parquet(target))
