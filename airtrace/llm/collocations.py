"""Phrase collocations by FM-index shards.

A task packs whole texts into shards of about ``SHARD_BYTES`` and builds one
FM-index per shard over word ids: suffixes sorted by their first ``depth``
words (end of piece lowest), of which only ``psi`` is kept, the inverse of the
BWT's last-to-first mapping: ``psi[j]`` is the rank of suffix j without its
first word, -1 at the end of a piece. A phrase is an interval of ranks. Phrases
of L + 1 words are the runs of ranks j in which both the L-word interval of j
(extended to the right by a word) and that of ``psi[j]`` (extended to the left)
are known, so one gather extends all intervals of a shard in both directions.

Shards are enumerated level by level and summed across shards: a phrase goes on
to the next level only where its total reaches ``min_count``, as no longer
phrase can be more frequent than its parts. A shard's index shrinks with it to
the ranks that can still be extended. Totals come from a window over the
shards' rows, so the same shuffle that sums also tells every shard which of its
intervals stay; nothing is broadcast or sent to the driver.

Defined results: null or empty texts have no words; a null language is ``und``;
rows repeated in full count each time; an empty table gives no rows. Bytes
other than the separators are word bytes. A shard is at least one text, so a
task's memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialize
from .kernels import LOWER, pieces
from .tables import batch

SHARD_BYTES = 8 << 20
#: Phrases that are spelled at a time.
SPELLED = 1 << 16
#: A row is a shard of several megabytes: the writer looks at its size after each row, not after the first hundred, and readers get few at a time.
WIDE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Rows of an Arrow batch: of texts, and of indexes, of which a task then holds one.
TEXT_ROWS, INDEX_ROWS = 1000, 1
#: Byte classes: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.int8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?"]] = 2
KIND[0x0A:0x0E] = 2
INDEX = "shard long, words array<string>, langs array<string>, counts binary, psi binary"
ROWS = "shard long, start int, count long, key string, psi binary"
UNKNOWN = "und"


def _words(column: pa.Array, langs: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Per piece of the column: words, the language number of each, and whether the next word is in the same piece."""
    for p in pieces(column):
        kind = KIND[p.data]
        solid = np.zeros(len(kind) + 2, bool)
        solid[1:-1] = kind == 0
        start, end = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = p.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(kind))]
        start[inner] |= solid[inner + 1]
        end[inner - 1] |= solid[inner]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        breaks = np.cumsum(kind == 2)
        row = np.searchsorted(p.offsets, starts, "right") - 1
        joined = np.zeros(len(starts), bool)
        if len(starts):
            joined[:-1] = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[starts[:-1]])
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        spelled = LOWER[p.data[solid[1:-1]]]
        text = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(spelled))])
        yield text.dictionary_encode(), langs[p.first + row], joined


class Index:
    """FM-index of one shard: symbols (a word of a language) in suffix order and ``psi``."""

    def __init__(self, words: pa.ChunkedArray, langs: np.ndarray, joined: np.ndarray, depth: int):
        coded = words.unify_dictionaries().combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        self.words = coded.dictionary
        n, width = len(coded), len(coded.dictionary)
        pairs, symbol = np.unique(langs.astype(np.int64) * width + coded.indices.to_numpy(), return_inverse=True)
        self.lang, self.word = pairs // width, pairs % width
        # Suffixes by their first words: ranks of 1, 2, 4, ... words, an absent word lowest.
        rank, reach = symbol.astype(np.int64), 1
        open_ = np.cumsum(~joined) - ~joined  # number of the piece of each word
        while reach < depth:
            step = min(reach, depth - reach)
            after = np.zeros(n, np.int64)
            same = open_[step:] == open_[:-step]
            after[:-step][same] = rank[step:][same] + 1
            _, rank = np.unique(rank * (rank.max(initial=0) + 2) + after, return_inverse=True)
            reach += step
        order = np.argsort(rank, kind="stable")
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        self.first = symbol[order]
        self.psi = np.full(n, -1, np.int32)
        self.psi[at[:-1][joined[:-1]]] = at[1:][joined[:-1]]


def _runs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal (left, right)."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return starts, np.diff(np.append(starts, len(left)))


def extend(psi: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extend all known intervals by a word to both sides.

    ``known[j]`` is the number of the interval of rank j, -1 where it does not
    count. Returns the starts, lengths, left and right interval numbers of the
    longer phrases, and the index of the ranks they lie in; starts are ranks of that index.
    """
    after = np.where(psi >= 0, known[psi], -1)
    alive = np.flatnonzero((known >= 0) & (after >= 0))
    left, right = known[alive], after[alive]
    starts, lengths = _runs(left, right)
    renumbered = np.full(len(psi) + 1, -1, np.int32)
    renumbered[alive] = np.arange(len(alive), dtype=np.int32)
    return starts, lengths, left[starts], right[starts], renumbered[psi[alive]]


def _indexes(depth: int):
    """Texts to one row of ``INDEX`` per shard."""

    def row(shard: int, held: list, names: list[str]) -> pa.RecordBatch:
        index = Index(pa.chunked_array([w for w, _, _ in held]), np.concatenate([g for _, g, _ in held]), np.concatenate([j for _, _, j in held]), depth)
        held.clear()
        words = index.words.take(pa.array(index.word)).to_pylist()
        language = [names[i] for i in index.lang]
        counts = np.bincount(index.first, minlength=len(index.lang)).astype(np.int32)
        return batch({
            "shard": ([shard], pa.int64()), "words": ([words], pa.list_(pa.string())), "langs": ([language], pa.list_(pa.string())),
            "counts": ([counts.tobytes()], pa.binary()), "psi": ([index.psi.tobytes()], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size, names = TaskContext.get().partitionId() << 32, [], 0, {}
        for b in batches:
            own = np.array([names.setdefault(x, len(names)) for x in b["lang"].to_pylist()], np.int64)
            for words, langs, joined in _words(b["text"], own):
                held.append((words, langs, joined))
                size += 8 * len(words) + words.dictionary.nbytes
                if size >= SHARD_BYTES:
                    yield row(shard, held, list(names))
                    pa.default_memory_pool().release_unused()
                    shard, size = shard + 1, 0
        if held:
            yield row(shard, held, list(names))
        pa.default_memory_pool().release_unused()

    return run


def _labels(words: pa.Array, langs: pa.Array) -> pa.Array:
    """Keys of phrases: no phrase holds a newline, so the last one ends it (first here) and the language follows."""
    return pc.binary_join_element_wise(words, langs, "\n")


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of every shard and their counts."""
    for b in batches:
        for i in range(b.num_rows):
            counts = np.frombuffer(b["counts"][i].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([_labels(b["words"][i].values, b["langs"][i].values), pa.array(counts, pa.int64())], names=["key", "count"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of two words of every shard, as ranks of the index without the ranks that have no second word."""
    for b in batches:
        for i in range(b.num_rows):
            words, keys = b["words"][i].values, _labels(b["words"][i].values, b["langs"][i].values)
            counts = np.frombuffer(b["counts"][i].as_py(), np.int32)
            first = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            starts, lengths, left, right, _ = extend(np.frombuffer(b["psi"][i].as_py(), np.int32), first)
            for a in range(0, len(starts), SPELLED):
                c = slice(a, a + SPELLED)
                phrase = pc.binary_join_element_wise(words.take(pa.array(left[c])), keys.take(pa.array(right[c])), " ")
                yield _rows(b["shard"][i].as_py(), starts[c], lengths[c], phrase)
        pa.default_memory_pool().release_unused()


def _rows(shard: int, start: np.ndarray, count: np.ndarray, key: pa.Array) -> pa.RecordBatch:
    n = len(count)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(shard, pa.int64()), n), pa.array(start, pa.int32()), pa.array(count, pa.int64()), key.cast(pa.string()), pa.nulls(n, pa.binary())],
        names=["shard", "start", "count", "key", "psi"],
    )


def _trimmed(psi: np.ndarray) -> np.ndarray:
    """The index that ``_pairs`` counts ranks of: level one knows every rank."""
    return extend(psi, np.zeros(len(psi), np.int32))[4]


def _next_level(index: pa.Table, hits: pa.Table) -> pa.Table:
    """A shard's index and its intervals that stay, to rows of ``ROWS`` one word longer and the index that is left."""
    shard = index["shard"][0].as_py() if index.num_rows else 0
    one = {"shard": ([shard], pa.int64()), "start": ([None], pa.int32()), "count": ([None], pa.int64()), "key": ([None], pa.string())}
    if not index.num_rows or not hits.num_rows:
        return batch({**one, "psi": ([None], pa.binary())}).schema.empty_table()
    psi = np.frombuffer(index["psi"][0].as_py(), np.int32)
    if index["whole"][0].as_py():
        psi = _trimmed(psi)
    start, count = hits["start"].to_numpy(), hits["count"].to_numpy()
    known = np.full(len(psi), -1, np.int64)
    known[np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())] = np.repeat(np.arange(len(start)), count)
    starts, lengths, left, right, rest = extend(psi, known)
    key = hits["key"].combine_chunks()
    out = [batch({**one, "psi": ([rest.astype(np.int32).tobytes()], pa.binary())})]
    # In a large table most phrases of a shard stay, so only what is given back is held for all of them.
    for a in range(0, len(starts), SPELLED):
        c = slice(a, a + SPELLED)
        phrase = pc.replace_substring_regex(key.take(pa.array(left[c])), r"\n(?s:.*)$", "")
        last = pc.replace_substring_regex(key.take(pa.array(right[c])), r"^[^\n]* ", "")
        out.append(_rows(shard, starts[c], lengths[c], pc.binary_join_element_wise(phrase, last, " ")))
    return pa.Table.from_batches(out)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def phrase_counts(docs: DataFrame, depth: int = 4, min_count: int = 30) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, count`` of the phrases of 1 to ``depth`` words with ``min_count``, and ``lang, n`` with all word occurrences."""
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        index = materialize(given.where("text is not null").mapInArrow(_indexes(max(depth, 2)), INDEX), "index", WIDE_ROWS)
    singles = index.select("words", "langs", "counts").mapInArrow(_single, "key string, count long")
    with arrow_rows(docs.sparkSession, INDEX_ROWS):
        single = materialize(singles.groupBy("key").agg(F.sum("count").alias("count")), "words")
    named = [F.substring_index("key", "\n", 1).alias("phrase"), F.expr("substr(key, instr(key, '\n') + 1)").alias("lang")]
    n = single.select("count", *named).groupBy("lang").agg(F.sum("count").alias("n"))
    found = [single.where(F.col("count") >= min_count).select(*named, F.lit(1).alias("words"), "count")]
    level = index.select("shard", "words", "langs", "counts", "psi").mapInArrow(_pairs, ROWS)
    rest = index.select("shard", "psi", F.lit(True).alias("whole"))
    each, done = Window.partitionBy("key"), index
    for words in range(2, depth + 1):
        rows = level.where("key is not null").select("shard", "start", "count", "key")
        totals = rows.select("*", F.sum("count").over(each).alias("total"), F.row_number().over(each.orderBy("key")).alias("nth"))
        with arrow_rows(docs.sparkSession, INDEX_ROWS if words == 2 else TEXT_ROWS):
            kept = materialize(totals.where(F.col("total") >= min_count), "kept")
        found.append(kept.where("nth = 1").select(*named, F.lit(words).alias("words"), F.col("total").alias("count")))
        if words < depth:
            hits = kept.select("shard", "start", "count", "key")
            level = materialize(rest.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(_next_level, ROWS), "phrases")
            rest = level.where("psi is not null").select("shard", "psi", F.lit(False).alias("whole"))
            # The index before is in this one; nothing reads it any more.
            discard(done)
            done = level
    return reduce(DataFrame.unionByName, found), n


def collocations(
    docs: DataFrame, depth: int = 4, min_count: int = 30, top: int = 2000, scale: int = 2_000_000, inside: int = 80,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` and the largest extension ``longer``: each language's first ``top`` phrases.

    A phrase's score is ``floor(scale * a / (l + r))`` at its lowest-scoring cut. Phrases that a longer one
    contains in ``inside`` percent or more of their occurrences are dropped; as counts fall with length, looking
    one word further to the left and to the right is enough.
    """
    counts, totals = phrase_counts(docs, depth, min_count)
    known = materialize(counts, "counts")
    word = F.split("phrase", " ")
    longer = known.where("words > 2").select("lang", "count", F.explode(F.array(
        F.array_join(F.slice(word, 1, F.size(word) - 1), " "), F.array_join(F.slice(word, 2, F.size(word) - 1), " "),
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    wide = "decimal(38,0)"
    found = known.where("words > 1").join(longer, ["lang", "phrase"], "left")
    kept = found.where(F.col("longer").isNull() | (F.lit(100).cast("decimal(10,0)") * F.col("longer").cast("decimal(20,0)") < F.lit(inside).cast("decimal(10,0)") * F.col("count").cast("decimal(20,0)")))
    cuts = kept.select("lang", "phrase", F.col("count").alias("a"), "longer", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cuts.select("*", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("_l"), F.array_join(F.slice(word, F.col("k") + 1, F.size(word) - F.col("k")), " ").alias("_r"))
    sides = known.where(F.col("words") < depth)
    for side, name in (("_l", "l"), ("_r", "r")):
        parts = parts.join(sides.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    scaled = F.lit(scale).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")
    score = F.expr("_s div _t").cast("long")
    scored = parts.select("*", scaled.cast(wide).alias("_s"), (F.col("l").cast("decimal(20,0)") + F.col("r")).cast(wide).alias("_t")).select("lang", "phrase", "a", "longer", F.struct(score.alias("score"), "k", "l", "r").alias("c"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("longer").alias("longer"), F.min("c").alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"), "longer",
    )
