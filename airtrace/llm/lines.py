"""Line deduplication over range-partitioned line hashes.

Lines are read with their document and position, and their normalised keys are
hashed to 128 bits. The occurrences are range-partitioned by hash and slice (a
share of the documents, so that a line of very many documents is dealt to
several tasks) and sorted by document, greatest first, and position. A window
streams them: it tells a document's first occurrence of a key from its repeats,
and the greatest document from the others. Slices add up to totals per key, and
the occurrences that must go come back as bitmaps per document, not as text.

A bitmap is a map from word number to 64 keep bits; words that keep all their
lines are left out.

Defined results: null or empty text is one empty line; rows repeated in full
share one bitmap; rows of one ``doc_id`` with different texts count as one
document; a null ``doc_id`` is one document below all others; an empty table gives no
rows. Extra columns are carried by ``apply_bitmaps`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tables import SPACES

NO_ID = -(1 << 63)
SLICES = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACES)))


def _identity(docs: DataFrame) -> list[Column]:
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"),
    ]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``_id, _text, pos, h1, h2`` of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(*_identity(docs), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("_id", "_text", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("_id", "_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents that lose lines: ``_id``, ``_text``, ``keep_words``, ``n_dropped``.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents
    stay in the greatest document that has them.
    """
    found = materialize(occurrences(docs, min_chars), "lines").withColumn("slice", F.pmod(F.xxhash64("_id"), F.lit(SLICES)))
    ranged = found.repartitionByRange("h1", "h2", "slice")
    order = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc("_id"), "_text", "pos")
    before = F.lag("_id").over(order)
    streamed = ranged.withColumn("first", F.when(before.isNull() | (before != F.col("_id")), 1).otherwise(0))
    slices = streamed.groupBy("h1", "h2", "slice").agg(F.sum("first").alias("docs"), F.max("_id").alias("top"))
    totals = slices.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
    shared = totals.where(F.col("docs") >= min_docs).select("h1", "h2", "top")
    gone = found.join(shared, ["h1", "h2"]).where(F.col("_id") < F.col("top"))
    words = gone.groupBy("_id", "_text", (F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop")
    )
    return words.groupBy("_id", "_text").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("keep")))).alias("keep_words"),
        F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"),
    )


def apply_bitmaps(docs: DataFrame, found: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with the kept lines as ``text``; ``counts`` adds ``n_lines`` and ``n_dropped``, which must not be columns yet."""
    # No column of ``docs`` starts with the mark, so no name can clash.
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    id_, text_ = _identity(docs)
    keys = [f"{mark}id", f"{mark}text"]
    rows = docs.select("*", id_.alias(keys[0]), text_.alias(keys[1]))
    named = dict(zip(("_id", "_text", "keep_words", "n_dropped"), (*keys, f"{mark}keep", f"{mark}dropped")))
    joined = rows.join(found.select(*[F.col(c).alias(n) for c, n in named.items()]), keys, "left")
    text, words = F.col("text").cast("string"), F.col(f"{mark}keep")

    def stays(_, i):
        word = F.try_element_at(words, F.floor(i / 64).cast("int"))
        return F.coalesce(F.getbit(word, i % 64) == 1, F.lit(True))

    kept = F.when(words.isNull(), text).otherwise(F.array_join(F.filter(split_lines(text), stays), "\n")).alias("text")
    out = [kept if c == "text" else joined[c] for c in docs.columns]
    if counts:
        if {"n_lines", "n_dropped"} & {c.lower() for c in docs.columns}:
            raise ValueError("n_lines and n_dropped are columns already")
        dropped = F.coalesce(f"{mark}dropped", F.lit(0)).cast("long")
        out += [F.size(split_lines(text)).cast("long").alias("n_lines"), dropped.alias("n_dropped")]
    return joined.select(*out)
