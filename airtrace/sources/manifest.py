"""Landed-file manifests, schema fingerprints and drift."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.hashtree import FAN, tree_roots

RANGE_BYTES = 64 << 20

MANIFEST_SCHEMA = (
    "kind string, source string, path string, sha256 string, size_bytes bigint, "
    "fingerprint string, columns array<string>, recorded_at string"
)


class SchemaDriftError(ValueError):
    """A source changed its columns without acknowledgement."""


def file_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, size_bytes, at, offset, length`` of every byte range of the files under ``path``; no content is read.

    Spark's reader lists no empty files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))
    last = F.floor(F.greatest(F.col("size_bytes") - 1, F.lit(0)) / range_bytes)
    cut = files.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    offset = F.col("at") * range_bytes
    return cut.select("path", "size_bytes", "at", offset.alias("offset"), F.least(F.lit(range_bytes), F.col("size_bytes") - offset).alias("length"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every byte range, read a mebibyte at a time."""
    for b in batches:
        for i, (path, offset, length) in enumerate(zip(*(b[c].to_pylist() for c in ("path", "offset", "length")))):
            # Spark gives plain paths, and a uri has its odd characters escaped.
            system, name = fs.FileSystem.from_uri(quote(path, safe="/:=,+@"))
            digest, left = hashlib.sha256(), length
            with system.open_input_file(name) as source:
                source.seek(offset)
                while left:
                    data = source.read(min(left, 1 << 20))
                    if not data:
                        raise OSError(f"{path} ends {left} bytes before its range does")
                    digest.update(data)
                    left -= len(data)
            one = b.slice(i, 1)
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([digest.hexdigest()])], names=[*b.schema.names, "hash"])


def hash_ranges(ranges: DataFrame) -> DataFrame:
    """Add ``hash``; every range may be read by its own task, whatever file it is of."""
    return ranges.repartition("path", "at").mapInArrow(_digests, StructType([*ranges.schema.fields, StructField("hash", StringType())]))


def file_manifest(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """``file, path, sha256, size_bytes, fingerprint`` of every landed file, of any size.

    ``sha256`` is of the whole file, streamed by one task in bounded memory;
    ``fingerprint`` is the root of a hash tree over its byte ranges, which many tasks read.
    """
    ranges = file_ranges(spark, path, range_bytes)
    roots = tree_roots(hash_ranges(ranges), ["path"], fan).select("path", F.col("root").alias("fingerprint"))
    whole = ranges.where("at = 0").select("path", "size_bytes", "at", "offset", F.col("size_bytes").alias("length"))
    return hash_ranges(whole).join(roots, "path").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path", F.col("hash").alias("sha256"), "size_bytes", "fingerprint",
    )


def append_manifest(entries: DataFrame, target: str) -> None:
    entries.withColumn("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).write.mode(
        "append"
    ).json(target)


def parse_manifest(lines: DataFrame, schema: str = MANIFEST_SCHEMA, text: str = "value") -> DataFrame:
    """Entries of JSON lines; blank lines are skipped."""
    return lines.where(F.trim(text) != "").select(F.from_json(text, schema).alias("e")).select("e.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest folder, empty when nothing has been recorded."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return parse_manifest(spark.read.text(path))


def fingerprints(columns: DataFrame, source: str = "source", name: str = "name", kind: str = "type") -> DataFrame:
    """Order-independent hash of each source's ``name:type`` pairs."""
    pair = F.concat_ws(":", name, kind)
    pairs = columns.select(source, pair.alias("p")).distinct()
    return pairs.groupBy(source).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("p")), ";"), 256).alias("fingerprint")
    )


def frame_fingerprint(df: DataFrame) -> str:
    """The same hash from a frame's schema; no job is run."""
    pairs = sorted({f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields})
    return hashlib.sha256(";".join(pairs).encode()).hexdigest()


def drift_verdicts(history: DataFrame) -> DataFrame:
    """Add ``baseline`` and ``drift`` to attempts ``(source, seq, fingerprint, acknowledged)``.

    The baseline moves only at the first sighting and at acknowledged
    attempts; a rejected attempt leaves no trace.
    """
    w = Window.partitionBy("source").orderBy("seq")
    first = F.row_number().over(w) == 1
    moves = F.when(F.col("acknowledged") | F.col("_first"), F.col("fingerprint"))
    return (
        history.withColumn("_first", first)
        .withColumn("baseline", F.last(moves, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn(
            "drift",
            F.coalesce((F.col("fingerprint") != F.col("baseline")) & ~F.col("acknowledged"), F.lit(False)),
        )
        .drop("_first")
    )


def check_drift(df: DataFrame, source: str, manifest: str, allow_new_schema: bool = False) -> str:
    """Sink-side guard: record the fingerprint or raise on unacknowledged change."""
    spark = df.sparkSession
    current = frame_fingerprint(df)
    seen = read_manifest(spark, manifest).where((F.col("kind") == "schema") & (F.col("source") == source))
    last = seen.agg(F.max_by("fingerprint", "recorded_at").alias("f")).first()["f"]
    if last is not None and last != current and not allow_new_schema:
        raise SchemaDriftError(f"{source}: schema changed {last[:8]} -> {current[:8]}")
    entry = spark.createDataFrame(
        [("schema", source, current, sorted(df.columns))],
        "kind string, source string, fingerprint string, columns array<string>",
    ).withColumn("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    entry.write.mode("append").json(manifest)
    return current
