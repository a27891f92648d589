"""Run-record folders: indexing, writing and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from ..operators.hashtree import FAN, tree_roots
from ..operators.ranking import row_numbers
from ..operators.report import guard_withdrawn

RECORD_SCHEMA = (
    "event_id string, basin string, det_date string, lon double, lat double, u10_ms double, "
    "result_status string, superseded boolean, do_not_quote boolean, cloud_screening boolean, "
    "pixels_target_safe string, pixels_background_safe string, "
    "gates struct<sigma_col_ppb: double>, q_output struct<Q: double>, "
    "q_output_withheld_artifact_dominated struct<Q: double>, "
    "event_class string, z_peak double, cue_action string, cue_reason string, context_verdict string, "
    "quant struct<q_kg_h: double, n_pixels: long>, wind_source string, generated_at string, code_commit string, config_sha256 string"
)


def parse_records(files: DataFrame, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records from ``(path, text)``; unreadable and non-object texts are skipped."""
    bundle = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    is_object = F.try_parse_json("text").isNotNull() & F.trim("text").startswith("{")
    return (
        files.where(is_object)
        .select(bundle.alias("bundle_name"), F.from_json("text", schema).alias("r"))
        .select("bundle_name", "r.*")
        .withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit("")), "bundle_name"))
    )


def read_records(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("wholetext", True).text(f"{root}/*/provenance.json")
    return parse_records(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def write_records(records: DataFrame, stored: DataFrame, target: str, force: bool = False) -> None:
    """Append records by basin, keeping withdrawn ids untouched unless forced.

    An id that is written again is replaced for ``read_written``, which takes
    the latest batch; nothing is rewritten in place.
    """
    kept = guard_withdrawn(records, stored, force)
    kept.withColumn("written_at", F.current_timestamp()).write.mode("append").partitionBy("basin").json(target)


def read_written(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The latest record of every event id under ``target``."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("written_at", TimestampType())])).json(target)
    # A folder holds an id once per batch, so nothing combines before the shuffle; dealt out first, records are sorted once.
    latest = rows.repartition("event_id").groupBy("event_id").agg(F.max_by(F.struct(*[c for c in schema.names if c != "event_id"]), "written_at").alias("r"))
    return latest.select("event_id", "r.*")


def folder_integrity(files: DataFrame, fan: int = FAN) -> DataFrame:
    """One hash per folder over its files' names and contents, independent of file order.

    A file is reduced to the hash of its name and its content's hash; a tree
    over the files in order of name gives the folder's, so no row grows with the folder.
    """
    line = F.concat_ws(":", "file", F.sha2(F.col("content").cast("binary"), 256))
    each = files.select("folder", "file", F.sha2(line, 256).alias("hash"))
    leaves = row_numbers(each, [F.col("file"), F.col("hash")], "_no", ["folder"]).select("folder", (F.col("_no") - 1).alias("at"), "hash")
    return tree_roots(leaves, ["folder"], fan).select("folder", F.col("n").alias("n_files"), F.col("root").alias("integrity"))
