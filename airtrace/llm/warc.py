"""WARC archives with a two-level capture index.

``write_archives`` turns pages into WARC/1.1 records (response, or revisit of the
response with the same payload) through Spark's file sink, so a lost task leaves
no torn file. ``build_index`` reads the record headers of every file, sorts the captures
by reversed-host URL key and packs them into compressed blocks; a sparse
directory holds each block's first and last key, in slices of ``SLICE_BLOCKS``
blocks. A table of keys is looked up through it (``look_up``): the slices' key
ranges, one per ``SLICE_BLOCKS * BLOCK_ENTRIES`` captures, are given to every
task, a key is sent to its slices and searched there by bisection, then in its
blocks, and every record is read by its byte range alone.

The archive folder is read with seeks from the tasks, so it must be a store that
pyarrow's file systems open (local or mounted folder, HDFS, object stores).
Archives have no ``warcinfo`` record and no compression of single records.

Defined results: null html is an empty payload; a null url has the empty key; rows
repeated in full are separate captures of one page id; a null ``page_id`` never is
the response that others revisit; ties of a key are ordered by file and offset; an
empty table gives an empty archive and index.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_ENTRIES = 3000
SLICE_BLOCKS = 512
RECORDS_PER_FILE = 50_000
MIN_PAYLOAD = 100
END = "\r\n\r\n"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_END = b"\r\n\r\n"


def _lines(*parts: tuple[str, Column | str]) -> Column:
    """``Name: value`` header lines; a part with a null value is left out."""
    made = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value.cast("string")) for name, value in parts]
    return F.concat_ws("\r\n", *made)


def target_uri(url: Column) -> Column:
    """The url as a header value: line ends escaped."""
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of ``pages`` (``page_id``, ``url``, ``html``) under ``folder``.

    Of equal payloads of at least ``MIN_PAYLOAD`` bytes, the one with the smallest
    page id is the response and the others revisit it.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).alias("bytes"), F.sha2(html, 256).alias("digest"),
    )
    known = materialize(rows.where(F.col("bytes") >= MIN_PAYLOAD).select("page_id", "digest"), "payloads")
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = known.join(first.drop("n"), "digest").where("not page_id <=> refers_to").distinct()
    # Written first, so that its true size decides how it is joined.
    again = materialize(again.withColumn("page_id", F.coalesce("page_id", F.lit(-1 << 63))), "revisits")
    joined = rows.withColumn("_id", F.coalesce("page_id", F.lit(-1 << 63))).join(again.withColumnRenamed("page_id", "_id"), ["_id", "digest"], "left")
    http = F.concat(
        _lines(("HTTP/1.1 200 OK\r\nContent-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("bytes"))), F.lit(END)
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    uri = target_uri(F.col("url"))
    header = _lines(
        ("WARC/1.1\r\nWARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", F.octet_length(block)),
    )
    record = joined.select(F.concat(header, F.lit(END), block).alias("value"))
    record.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(folder)


def url_key(url: str) -> str:
    """Reversed-host key: ``http://www.a.org/x`` is ``org,a,www)/x``."""
    m = re.match(r"[^:/?#]+://([^/?#]*)(.*)", url, re.S)
    if not m:
        return url
    host = m[1].rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:] if ": " in x)}


def _records(path: str) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and headers of every record of a file; blocks are skipped by their length."""
    with _open(path) as f:
        end, at = f.size(), 0
        while at < end:
            f.seek(at)
            head = b""
            while HEADER_END not in head:
                more = f.read(2048)
                if not more:
                    raise ValueError(f"{path}: record at {at} has no end of header")
                head += more
            cut = head.index(HEADER_END) + len(HEADER_END)
            headers = _headers(head[:cut])
            length = cut + int(headers["content-length"])
            yield at, length, headers
            at += length + len(HEADER_END)


CAPTURES = "key string, date string, type string, file string, offset long, length long"


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives: URL key, date, type, file, offset and length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "date", "type", "file", "offset", "length"]
        for b in batches:
            for path in b["path"].to_pylist():
                rows = []
                for offset, length, h in _records(path):
                    rows.append((url_key(h.get("warc-target-uri", "")), h["warc-date"], h["warc-type"], path, offset, length))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path")
    return files.repartition("path").mapInArrow(scan, CAPTURES)


def build_index(spark: SparkSession, archives: str, folder: str) -> None:
    """Write ``folder/blocks`` (compressed runs of sorted captures) and ``folder/directory`` (their key ranges)."""
    found = materialize(captures(spark, archives), "captures")
    ordered = found.repartitionByRange("key", "date", "file", "offset").sortWithinPartitions("key", "date", "file", "offset")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        # Range partitions are in order of keys, so slices are too.
        part, number = TaskContext.get().partitionId(), count()

        def block(rows):
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
            columns = [[f"{rows[0][3]}@{rows[0][4]}"], [(part << 32) + next(number) // SLICE_BLOCKS], [rows[0][0]], [rows[-1][0]], [len(rows)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "slice", "first_key", "last_key", "entries", "data"])

        for b in batches:
            held += zip(*(b[c].to_pylist() for c in ("key", "date", "type", "file", "offset", "length")))
            while len(held) >= BLOCK_ENTRIES:
                yield block(held[:BLOCK_ENTRIES])
                held = held[BLOCK_ENTRIES:]
        if held:
            yield block(held)

    ordered.mapInArrow(blocks, "block string, slice long, first_key string, last_key string, entries long, data binary").write.parquet(f"{folder}/blocks")
    spark.read.parquet(f"{folder}/blocks").select("block", "slice", "first_key", "last_key").write.parquet(f"{folder}/directory")


def look_up(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """Captures of the distinct URL keys in ``keys`` (column ``key``), found through the directory.

    A key of very many captures goes to all slices and blocks that it fills; each is searched by itself.
    """
    directory = spark.read.parquet(f"{index}/directory")
    ranges = sorted(map(tuple, directory.groupBy("slice").agg(F.min("first_key"), F.max("last_key")).collect()))
    slices, first, last = ([r[i] for r in ranges] for i in range(3))

    def send(keys: pa.Array) -> pa.Array:
        return pa.array([slices[bisect.bisect_left(last, k) : bisect.bisect_right(first, k)] for k in keys.to_pylist()], pa.list_(pa.int64()))

    def in_slice(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = sorted(zip(*(blocks[c].to_pylist() for c in ("first_key", "last_key", "block"))))
        first, last = [r[0] for r in rows], [r[1] for r in rows]
        hits = [(rows[i][2], k) for k in asked["key"].to_pylist() for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))]
        return pa.table({"block": pa.array([h[0] for h in hits], pa.string()), "key": pa.array([h[1] for h in hits], pa.string())})

    def in_block(asked: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        for data in block["data"].to_pylist() if asked.num_rows else []:
            rows = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
            own = [r[0] for r in rows]
            found += [r for k in asked["key"].to_pylist() for r in rows[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]]
        types = [pa.string()] * 4 + [pa.int64()] * 2
        return pa.Table.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=["key", "date", "type", "file", "offset", "length"])

    sent = keys.select("key").where("key is not null").distinct().select("key", F.explode(F.arrow_udf(send, "array<long>")("key")).alias("slice"))
    hits = sent.groupBy("slice").cogroup(directory.groupBy("slice")).applyInArrow(in_slice, "block string, key string")
    blocks = spark.read.parquet(f"{index}/blocks").select("block", "data")
    return hits.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(in_block, CAPTURES)


def url_keys(url: Column) -> Column:
    """``url_key`` of a column of urls as archives have them, nulls as empty strings."""

    def run(urls: pa.Array) -> pa.Array:
        return pa.array([url_key(u or "") for u in urls.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(target_uri(url.cast("string")))


def entries(spark: SparkSession, index: str, keys: list[str] | None = None) -> DataFrame:
    """Captures of the index: all, or those of a stated list of URL keys.

    For a list, blocks are chosen from the directory and entries within a block
    by bisection over the sorted list and the sorted entries.
    """
    blocks = spark.read.parquet(f"{index}/blocks").select("block", "data")
    asked = sorted(set(keys)) if keys is not None else None
    if asked is not None:

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = [
                    name for name, first, last in zip(*(b[c].to_pylist() for c in ("block", "first_key", "last_key")))
                    if bisect.bisect_left(asked, first) < bisect.bisect_right(asked, last)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], names=["block"])

        chosen = spark.read.parquet(f"{index}/directory").mapInArrow(choose, "block string")
        blocks = blocks.join(chosen, "block", "left_semi")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["data"].to_pylist():
                rows = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                if asked is not None:
                    own = [r[0] for r in rows]
                    rows = [r for k in asked for r in rows[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "date", "type", "file", "offset", "length"])

    return blocks.select("data").mapInArrow(unpack, CAPTURES)


RECORD = "page_id long, key string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_records(found: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records of ``entries`` by byte range, in file order, and check payloads against their digests."""

    def number(name: str | None) -> int | None:
        digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source, rows, held = None, None, [], 0
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for file, offset, length, key in zip(*(b[c].to_pylist() for c in ("file", "offset", "length", "key"))):
                if file != path:
                    if source is not None:
                        source.close()
                    path, source = file, _open(file)
                source.seek(offset)
                record = source.read(length)
                head, block = record.split(HEADER_END, 1)
                http, payload = block.split(HEADER_END, 1)
                h = _headers(head)
                size, digest = int(_headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha256:")
                if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{file}: payload of the record at {offset} is not the one that was written")
                rows.append((number(h["warc-record-id"]), key, h["warc-type"], number(h.get("warc-refers-to")), size, digest, payload if payloads else None))
                held += len(record) if payloads else 0
                if len(rows) == 10_000 or held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    dealt = found.select("file", "offset", "length", "key", F.floor(F.col("offset") / (1 << 26)).alias("part"))
    return dealt.repartition("file", "part").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)
