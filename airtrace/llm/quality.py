"""Quality rules by isolation forest on rule statistics.

Every text yields five counts. A forest of random splits, grown on a bounded
sample of labelled count vectors with a low share of bad ones, gives each document an anomaly score from its path
lengths; the score above which a document is rejected comes from all labelled
rows, and never rejects more than a set share of those labelled good.

Defined results: a null or empty text has zero counts and fails the base rule;
repeated rows each get a verdict; a null ``doc_id`` is judged like any other;
without labels the forest rejects nothing; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .kernels import Piece, pieces, span_hashes, window_hashes, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 5
#: Bounds of the fit: rows in the sample (smallest id hashes), trees, rows per tree.
SAMPLE_ROWS, TREES, TREE_ROWS = 8192, 100, 256
#: Rows labelled bad in each tree's draw: enough to give their features a range, too few to form a crowd.
BAD_PER_TREE = 4
DEPTH = 8
SCORE_BINS = 1000
#: Largest share of rows labelled good that the calibrated threshold may reject.
GOOD_LOSS = 0.004


def _counts(piece: Piece) -> list[np.ndarray]:
    data, n = piece.data, len(piece)
    found = words(piece)
    bounds = found.bounds

    def per_row(flags):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[piece.offsets[1:]] - sums[piece.offsets[:-1]]

    solid = np.zeros(len(data) + 1, np.int64)
    np.add.at(solid, found.starts, 1)
    np.add.at(solid, found.ends, -1)
    inside = np.cumsum(solid)[:-1] > 0
    word_chars = per_row(inside & ((data & 0xC0) != 0x80))
    n_symbols = per_row(SYMBOL[data])

    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([piece.offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, piece.offsets[1:]])
    starts.sort()
    # A break that ends a row's last line sorts before the row's own end, so both lists stay aligned.
    ends.sort()
    row = np.concatenate([np.arange(n), np.searchsorted(piece.offsets, breaks, "right") - 1])
    row.sort()
    worded = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    hashes = span_hashes(data, starts, ends)
    order = np.lexsort((hashes, row))
    again = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    n_dup_lines = np.bincount(row[order][1:][again], minlength=n)

    windows = window_hashes(span_hashes(data, found.starts, found.ends), WINDOW)
    n_repeat = np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        own = windows[a : max(a, b - WINDOW + 1)]
        if len(own) < 2:
            continue
        ordered = np.sort(own)
        same = ordered[1:] == ordered[:-1]
        if same.any():
            twice = np.isin(own, ordered[1:][same])
            edge = np.zeros(b - a + 1, np.int64)
            edge[: len(own)] += twice
            edge[WINDOW : WINDOW + len(own)] -= twice
            n_repeat[i] = np.count_nonzero(np.cumsum(edge) > 0)
    return [np.diff(bounds), word_chars, n_symbols, n_dup_lines, n_repeat]


def rule_counts(text: Column) -> Column:
    """Struct of the five counts of a text column."""

    def count(column: pa.Array) -> pa.Array:
        parts = [_counts(p) for p in pieces(column)]
        arrays = [pa.array(np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(np.int64)) for i in range(len(COUNTS))]
        return pa.StructArray.from_arrays(arrays, names=COUNTS)

    return F.arrow_udf(count, ", ".join(f"{c} long" for c in COUNTS))(text)


def base_failed(n_words, n_repeat_words):
    """The base rule, on columns or arrays."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates of the counts, so that length alone is no anomaly."""
    n, chars, symbols, dup, repeat = counts.astype(float).T
    some = np.maximum(n, 1)
    return np.stack([chars / some, symbols / some, np.log1p(dup), repeat / some], axis=1)


@dataclass
class Forest:
    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    scale: float
    threshold: float = float("inf")

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected length): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] >= split[node]))
            total += length[node]
        return 2.0 ** -(total / max(1, len(self.feature)) / self.scale)


def _expected(n) -> np.ndarray:
    """Mean length of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(good: np.ndarray, bad: np.ndarray, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    size = 2 ** (DEPTH + 1) - 1
    trees = TREES if len(good) else 0

    def draw() -> np.ndarray:
        some = rng.choice(len(bad), min(BAD_PER_TREE, len(bad)), replace=False)
        rest = rng.choice(len(good), min(TREE_ROWS - len(some), len(good)), replace=False)
        return np.concatenate([bad[some], good[rest]])

    feature, split, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, draw(), 0)]
        while todo:
            node, rows, depth = todo.pop()
            spread = np.flatnonzero(rows.max(0) > rows.min(0))
            if depth == DEPTH or not len(spread):
                length[t, node] = depth + _expected(len(rows))
                continue
            f = rng.choice(spread)
            low, high = rows[:, f].min(), rows[:, f].max()
            at = high - rng.random() * (high - low)
            right = rows[:, f] >= at
            feature[t, node], split[t, node] = f, at
            todo += [(2 * node + 1, rows[~right], depth + 1), (2 * node + 2, rows[right], depth + 1)]
    return Forest(feature, split, length, float(_expected(min(TREE_ROWS, max(2, len(good))))))


def _score(forest: Forest, counts: list[Column]) -> Column:
    def score(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        return pa.array(forest.score(features(x)))

    return F.arrow_udf(score, "double")(*counts)


def passes(text: Column, forest: Forest) -> Column:
    """Whether a text passes the base rule and the forest; counted and scored in one call, so a task needs one worker."""

    def judge_texts(column: pa.Array) -> pa.Array:
        counts = np.concatenate([*(np.stack(_counts(p), axis=1) for p in pieces(column)), np.zeros((0, len(COUNTS)), np.int64)])
        failed = base_failed(counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")])
        return pa.array(~failed & (forest.score(features(counts)) < forest.threshold))

    return F.arrow_udf(judge_texts, "boolean")(text)


def fit(counted: DataFrame, labels: DataFrame) -> Forest:
    """Forest from a bounded sample of labelled rows, threshold from all labelled rows.

    ``counted`` has ``doc_id`` and the counts; ``labels`` has ``doc_id`` and
    ``quality`` (1 good, 0 bad). Scores meet labels in a histogram of
    ``SCORE_BINS`` bins, so the driver sees a fixed number of rows.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = counted.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", *COUNTS)
    labelled = materialize(passed.join(marks, "doc_id"), "labelled_counts")
    picked = labelled.orderBy(F.xxhash64("doc_id", *COUNTS), "doc_id").limit(SAMPLE_ROWS).select("quality", *COUNTS).collect()
    sample = np.array(picked, dtype=float).reshape(-1, 1 + len(COUNTS))
    is_good = sample[:, 0] == 1
    forest = grow(features(sample[is_good, 1:]), features(sample[~is_good, 1:]))
    scored = labelled.select("quality", _score(forest, [F.col(c) for c in COUNTS]).alias("score"))
    histogram = scored.groupBy(F.floor(F.col("score") * SCORE_BINS).alias("bin"), "quality").count().collect()
    good, bad = np.zeros(SCORE_BINS + 2), np.zeros(SCORE_BINS + 2)
    for r in histogram:
        (good if r["quality"] == 1 else bad)[r["bin"]] += r["count"]
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    allowed = np.flatnonzero((lost <= GOOD_LOSS * good.sum()) & (caught > lost))
    if len(allowed):
        best = allowed[np.argmax(caught[allowed] - lost[allowed])]
        forest.threshold = best / SCORE_BINS
    return forest


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``score``, one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id"), rule_counts(F.col("text").cast("string")).alias("c")).select("doc_id", "c.*")
    counted = materialize(rows, "rule_counts")
    return verdicts(counted, fit(counted, labels))


def verdicts(counted: DataFrame, forest: Forest) -> DataFrame:
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    scored = counted.withColumn("score", _score(forest, [F.col(c) for c in COUNTS]))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") < forest.threshold))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    text = F.col("text").cast("string")
    counted = materialize(docs.select("doc_id", rule_counts(text).alias("c")).select("doc_id", "c.*"), "rule_counts")
    forest = fit(counted, labels)
    return docs.where(passes(text, forest))
