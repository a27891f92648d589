"""Exact deduplication with a cuckoo-filter index of live digests.

A digest (SHA-256 of the text without white space) lives in one bucket of the
index by its first bits. A bucket has a cuckoo filter of 16-bit fingerprints and
the stored keys themselves, grouped by filter slot. A filter hit is looked up
among the slot's stored keys before it counts; when an insertion cannot be
placed, the filter doubles and is filled again from the stored keys; deleting a
key's last document takes its fingerprint out again.

The index is a table with one row per live digest and its slot state per bucket.
Rows meet it in two steps: each task folds its own rows into a local index, so
a digest leaves a task once however many copies it has, then every bucket takes
those partial entries in.

Defined results: a null text counts as empty, so null, empty and blank texts are
one group; rows repeated in full count each and are kept or dropped together
with their ``doc_id``; a null ``doc_id`` ranks after every other id of a tie; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SLOT = 4
MAX_KICKS = 200
#: Rows a task folds before it hands its partial entries on.
FOLD_KEYS = 50_000
NO_ID = (1 << 63) - 1


@dataclass
class Entry:
    """Live documents of one digest: how many, and the one that stays (most code points, then smallest id)."""

    count: int
    points: int
    keep: int

    def absorb(self, other: Entry) -> None:
        self.count += other.count
        if (-other.points, other.keep) < (-self.points, self.keep):
            self.points, self.keep = other.points, other.keep


@dataclass
class CuckooIndex:
    """Cuckoo filter over 32-byte digests with the stored keys behind it."""

    slots: int = 1024
    table: list[list[int]] = field(default_factory=list)
    keys: dict[int, dict[bytes, Entry]] = field(default_factory=dict)
    size: int = 0
    resizes: int = 0
    false_hits: int = 0

    def __post_init__(self):
        if not self.table:
            self.table = [[] for _ in range(self.slots)]

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "big") or 1

    def _first(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:18], "big") & (self.slots - 1)

    def _other(self, slot: int, mark: int) -> int:
        return slot ^ (mark * 0x5BD1E995 & (self.slots - 1))

    def _hit(self, digest: bytes) -> bool:
        mark, slot = self._print(digest), self._first(digest)
        return mark in self.table[slot] or mark in self.table[self._other(slot, mark)]

    def get(self, digest: bytes) -> Entry | None:
        """The digest's entry: asked of the filter first, verified against the stored keys of its slot."""
        if not self._hit(digest):
            return None
        found = self.keys.get(self._first(digest), {}).get(digest)
        self.false_hits += found is None
        return found

    def insert(self, digest: bytes, entry: Entry) -> None:
        found = self.get(digest)
        if found is not None:
            found.absorb(entry)
            return
        self.keys.setdefault(self._first(digest), {})[digest] = entry
        self.size += 1
        while not self._place(digest):
            self._grow()

    def delete(self, digest: bytes, count: int = 1) -> bool:
        """Take away ``count`` live documents; the last one removes the key. False: no such key."""
        found = self.get(digest)
        if found is None:
            return False
        found.count -= count
        if found.count <= 0:
            slot, mark = self._first(digest), self._print(digest)
            del self.keys[slot][digest]
            self.size -= 1
            for at in (slot, self._other(slot, mark)):
                if mark in self.table[at]:
                    self.table[at].remove(mark)
                    break
        return True

    def _place(self, digest: bytes) -> bool:
        mark, slot = self._print(digest), self._first(digest)
        for at in (slot, self._other(slot, mark)):
            if len(self.table[at]) < SLOT:
                self.table[at].append(mark)
                return True
        at = self._other(slot, mark)
        for kick in range(MAX_KICKS):
            self.table[at].append(mark)
            mark = self.table[at].pop(kick % SLOT)
            at = self._other(at, mark)
            if len(self.table[at]) < SLOT:
                self.table[at].append(mark)
                return True
        return False

    def _grow(self) -> None:
        """Double the filter and fill it again from the stored keys (the one that found no place is among them)."""
        stored = [x for own in self.keys.values() for x in own.items()]
        while True:
            self.resizes += 1
            self.slots *= 2
            self.table = [[] for _ in range(self.slots)]
            if all(self._place(d) for d, _ in stored):
                break
        self.keys = {}
        for d, e in stored:
            self.keys.setdefault(self._first(d), {})[d] = e


ENTRY = "bucket int, digest binary, count long, points long, keep long"


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` (32 bytes) and ``points`` (code points of the original text) per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, BLANKS, ""), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
    )


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _live(index: CuckooIndex, bucket: int | None) -> list[tuple]:
    return [
        (bucket, d, e.count, e.points, None if e.keep == NO_ID else e.keep) for own in index.keys.values() for d, e in own.items()
    ]


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "digest", "count", "points", "keep"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial entry per digest and fold of this task's rows."""
    index = CuckooIndex()
    for b in batches:
        for doc_id, digest, points in zip(*(b[c].to_pylist() for c in ("doc_id", "digest", "points"))):
            index.insert(digest, Entry(1, points, NO_ID if doc_id is None else doc_id))
        if index.size >= FOLD_KEYS:
            yield _entries(_live(index, None))
            index = CuckooIndex()
    yield _entries(_live(index, None))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take sorted partial entries into the index of their bucket; negative counts delete."""
    bucket, index, done = None, CuckooIndex(64), []
    for b in batches:
        for own, digest, count, points, keep in zip(*(b[c].to_pylist() for c in ("bucket", "digest", "count", "points", "keep"))):
            if own != bucket:
                done += _live(index, bucket)
                if len(done) >= 10_000:
                    yield _entries(done)
                    done = []
                bucket, index = own, CuckooIndex(64)
            if count > 0:
                index.insert(digest, Entry(count, points, NO_ID if keep is None else keep))
            else:
                index.delete(digest, -count)
    yield _entries(done + _live(index, bucket))


def _settle(partial: DataFrame, buckets: int) -> DataFrame:
    placed = partial.withColumn("bucket", bucket_of(F.col("digest"), buckets))
    # Insertions come before deletions in a bucket, so that the last live document decides.
    arranged = placed.repartition("bucket").sortWithinPartitions("bucket", F.col("count") < 0, "digest")
    return arranged.mapInArrow(_merge, ENTRY)


def build_index(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """Index of the ``digests`` rows: ``bucket``, ``digest``, ``count``, ``points``, ``keep``, one row per live digest."""
    return _settle(rows.mapInArrow(_fold, ENTRY), buckets)


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame, live: DataFrame, buckets: int = 4096) -> DataFrame:
    """The index after adding and removing documents (all as ``digests`` rows).

    ``live`` are the documents that remain; the entries that lose their keeper
    take the best of them.
    """
    gone = removed.groupBy("digest").agg((-F.count("*")).alias("count"))
    deletions = gone.select(F.lit(None).cast("int").alias("bucket"), "digest", "count", F.lit(0).cast("long").alias("points"), F.lit(None).cast("long").alias("keep"))
    after = _settle(index.unionByName(added.mapInArrow(_fold, ENTRY)).unionByName(deletions), buckets)
    rank = F.struct((-F.col("points")).alias("p"), F.coalesce("doc_id", F.lit(NO_ID)).alias("d"))
    best = live.join(gone.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min(rank).alias("best"))
    return after.join(best, "digest", "left").select(
        "bucket", "digest", "count", F.coalesce(-F.col("best.p"), "points").alias("points"),
        F.when(F.col("best").isNull(), F.col("keep")).otherwise(F.nullif("best.d", F.lit(NO_ID))).alias("keep"),
    )


def resolve(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Per ``digests`` row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest``."""
    return rows.join(index.select("digest", "count", "keep"), "digest").select(
        "doc_id", F.col("keep").alias("keep_id"), F.col("count").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"), "digest",
    )
