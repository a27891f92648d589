"""Language identification by prediction with partial matching.

Each language has byte contexts of orders 0 to 3 with their counts. A byte's
code length comes from the longest context that has seen it, reached through
escapes (method C: an escape weighs as many events as the context has seen
different bytes). The statistics are frozen, so the code length of a byte is a
function of the four bytes that end with it; a worker tabulates that function
once and adds table entries over whole texts. Bytes fold to ``CLASSES`` symbol
classes first: letters without case, bytes outside ASCII by their low bits, digits and the other signs one class each.

The counts come from a bounded sample: about ``TRAIN_BYTES`` of text per
language, in parts of ``PART_CHARS`` characters taken by hash of id and part, so
that neither few long documents nor one of them empties or floods it; the part
with a language's smallest hash is always in. Counting is grouped in Spark; at
most ``CLASSES ** 4`` counts per language reach the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
repeated rows each get a result; ties go to the first language in order; rows
with a null ``doc_id`` are predicted but never trained on; an empty or unlabelled
training set predicts ``und`` for all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import Piece, pieces

CLASSES = 40
FIRST_LETTER = 3
TRAIN_BYTES = 1_000_000
PART_CHARS = 4096
#: The fewest labelled rows of a language that a limit of the filter is learned from.
LEAST_ROWS = 20
#: Least share of a language's sampled parts that a window must lie in to count in the filter.
SPREAD = 0.01
#: A language's limit is this many quartile distances below the median of its labelled texts, where that is below zero.
SPREADS = 8
LETTER = regex.compile(r"\p{L}")


def _folding() -> np.ndarray:
    fold = np.zeros(256, np.int64)  # 0: other signs
    fold[[0x20, *range(0x09, 0x0E)]] = 1
    fold[0x30:0x3A] = 2
    for i in range(26):
        fold[0x41 + i] = fold[0x61 + i] = 3 + i
    # Continuation and lead bytes share the remaining classes by their low bits.
    fold[0x80:0xC0] = 29 + np.arange(64) % 8
    fold[0xC0:] = 37 + np.arange(64) % 3
    return fold


FOLD = _folding()


def _windows(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the four classes ending at every byte (blanks before the text), and row numbers' bounds."""
    cls = FOLD[piece.data]
    code = cls.copy()
    at = np.arange(len(cls)) - np.repeat(piece.offsets[:-1], np.diff(piece.offsets))
    for back in (1, 2, 3):
        before = np.ones(len(cls), np.int64)
        before[back:] = cls[:-back]
        before[at < back] = 1
        code += before * CLASSES**back
    return code, piece.offsets


def tabulate(counts: np.ndarray, out: np.ndarray) -> None:
    """Fill ``out`` with the bits of every four-class window under one language's counts of windows.

    The longest order is filled first class by first class, so no second table
    of that size is held.
    """
    seen = counts.reshape((CLASSES,) * 4)

    def step(own, shorter):
        total = own.sum(-1, keepdims=True, dtype=np.float64)
        kinds = (own > 0).sum(-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
            return np.where(own > 0, np.log2(total + kinds) - np.log2(own), escape + shorter)

    bits = np.full(CLASSES, np.log2(CLASSES))
    for order in range(3):
        bits = step(seen.sum(axis=tuple(range(3 - order)), dtype=np.float64), bits)
    table = out.view()
    table.shape = (CLASSES,) * 4  # never a copy, also of a column
    for first in range(CLASSES):
        table[first] = step(seen[first], bits)


class Model:
    """Frozen counts by language; a task tabulates them once and lets go of the tables when it ends."""

    def __init__(self, languages: list[str], codes: list[np.ndarray], counts: list[np.ndarray]):
        self.languages, self.codes, self.counts = languages, codes, counts
        self._table: np.ndarray | None = None
        self._savings: np.ndarray | None = None

    def tables(self) -> np.ndarray:
        if self._table is None:
            table = np.empty((CLASSES**4, len(self.languages)), np.float32)
            for i, (code, count) in enumerate(zip(self.codes, self.counts)):
                dense = np.zeros(CLASSES**4, np.int32)
                dense[code] = np.minimum(count, np.iinfo(np.int32).max)
                tabulate(dense, table[:, i])
                del dense
            self._table = table
        return self._table

    def savings(self) -> np.ndarray:
        """Bits that a letter saves against a uniform background, per window and language; other signs save nothing.

        The code is an even mixture of the language's and the background, so a letter that a language does not
        expect loses one bit at most, however wrong its high orders are.
        """
        if self._savings is None:
            # Turned in place and slab by slab: a worker holds one table.
            table, self._table = self.tables(), None
            for a in range(0, len(table), CLASSES**3):
                slab = table[a : a + CLASSES**3]
                np.log2(0.5 + np.exp2(np.float32(np.log2(CLASSES) - 1) - slab), out=slab)
                slab.reshape(-1, CLASSES, len(self.languages))[:, :FIRST_LETTER] = 0
            self._savings = table
        return self._savings

    def saved(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Bits saved by row and language, and the row's number of letters."""
        letters = np.concatenate([[0], np.cumsum(FOLD[piece.data] >= FIRST_LETTER)])
        return self.score(piece, self.savings()), letters[piece.offsets[1:]] - letters[piece.offsets[:-1]]

    def score(self, piece: Piece, table: np.ndarray | None = None) -> np.ndarray:
        """Code length in bits per row and language."""
        table = self.tables() if table is None else table
        out = np.zeros((len(piece), len(self.languages)))
        code, offsets = _windows(piece)
        step = 1 << 16
        row = np.repeat(np.arange(len(piece)), np.diff(offsets))
        for a in range(0, len(code), step):
            lengths, rows = table[code[a : a + step]], row[a : a + step]
            edges = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[edges]] += np.add.reduceat(lengths, edges, axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, train_bytes: int = TRAIN_BYTES, spread: float = 0.0) -> Model:
    """Counts of the four-class windows of about ``train_bytes`` bytes per non-null language of ``docs``.

    With ``spread``, windows count only where at least that share of a language's
    sampled parts has them, so that a few texts with a wrong label teach nothing.
    """
    rows = docs.where("doc_id is not null and lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    n_parts = F.ceil(F.char_length("text") / PART_CHARS).cast("int")
    parts = F.when(n_parts > 0, F.sequence(F.lit(0), n_parts - 1)).otherwise(F.array().cast("array<int>"))

    def draw(i):
        """The hash of a document's part as a number in [0, 1)."""
        return F.pmod(F.xxhash64("doc_id", i), F.lit(1_000_003)) / 1_000_003

    least = F.array_min(F.transform(parts, draw))
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")), F.min(least)).collect()}
    languages = sorted(k for k, (v, _) in sizes.items() if v)
    if not languages:
        return Model([], [], [])
    share = F.lit(-1.0)
    for lang in languages:
        size, first = sizes[lang]
        share = F.when(F.col("lang") == lang, max(train_bytes / size, first)).otherwise(share)
    drawn = rows.withColumn("share", share).withColumn("part", F.explode(F.filter(parts, lambda i: draw(i) <= F.col("share"))))
    drawn = drawn.select("lang", F.substring("text", F.col("part") * PART_CHARS + 1, F.lit(PART_CHARS)).alias("text"))
    number = F.element_at(F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))]), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b["lang"].to_numpy(zero_copy_only=False)
            for p in pieces(b["text"]):
                code, offsets = _windows(p)
                own = langs[p.first : p.first + len(p)].astype(np.int64)
                tagged = code + np.repeat(own + np.arange(len(p)) * len(languages), np.diff(offsets)) * CLASSES**4
                codes, counts = np.unique(tagged, return_counts=True)
                codes, parts = codes % (CLASSES**4 * len(languages)), np.ones(len(codes), np.int64)
                # A part's size stands under a code of its own, below zero.
                codes, counts, parts = np.append(codes, -1 - own), np.append(counts, np.zeros(len(own), np.int64)), np.append(parts, np.ones(len(own), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts), pa.array(parts)], names=["code", "n", "parts"])

    counted = drawn.select(number.alias("lang"), "text").mapInArrow(count, "code long, n long, parts long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("parts").alias("parts"))
    counted = counted.toPandas().sort_values("code")
    code, n, parts = (counted[c].to_numpy(np.int64) for c in ("code", "n", "parts"))
    total = np.ones(len(languages))
    total[-1 - code[code < 0]] = parts[code < 0]
    own = [(code // CLASSES**4 == i) & (parts >= spread * total[i]) & (code >= 0) for i in range(len(languages))]
    return Model(languages, [code[m] % CLASSES**4 for m in own], [n[m] for m in own])


def predicted(text: Column, model: Model) -> Column:
    """Struct ``lang_pred``, ``score`` (posterior of the best language at equal priors) and ``bits`` per byte."""

    def predict(column: pa.Array) -> pa.Array:
        lang, score, rate = [], [], []
        for p in pieces(column):
            bits = model.score(p) if model.languages else np.zeros((len(p), 0))
            letter = np.zeros(len(p.data) + 1, np.int64)
            low = p.data | 0x20
            letter[1:] = np.cumsum((low >= 0x61) & (low <= 0x7A))
            ascii_letter = letter[p.offsets[1:]] > letter[p.offsets[:-1]]
            for i in range(len(p)):
                lettered = bool(ascii_letter[i])
                if not lettered:
                    lettered = LETTER.search(p.data[p.offsets[i] : p.offsets[i + 1]].tobytes().decode("utf-8", "replace")) is not None
                if not lettered or not model.languages:
                    lang.append("und")
                    score.append(0.0)
                    rate.append(0.0)
                    continue
                best = int(np.argmin(bits[i]))
                lang.append(model.languages[best])
                score.append(float(1 / np.exp2(np.minimum(bits[i][best] - bits[i], 0)).sum()))
                rate.append(float(bits[i][best] / (p.offsets[i + 1] - p.offsets[i])))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["lang_pred", "score", "bits"])

    return F.arrow_udf(predict, "lang_pred string, score double, bits double")(text)


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` columns ``doc_id`` with ``lang_pred``, ``score`` and ``bits``, learned from ``training``."""
    model = fit(training)
    text = F.col("text").cast("string")
    return docs.select("doc_id", predicted(text, model).alias("p")).select("doc_id", "p.*")


def saved(text: Column, model: Model) -> Column:
    """Struct ``lang_pred`` and ``saved`` (bits a letter against the background) of the language that saves most; ``und`` without a letter."""

    def measure(column: pa.Array) -> pa.Array:
        lang, gain = [], []
        for p in pieces(column):
            bits, letters = model.saved(p) if model.languages else (np.zeros((len(p), 0)), np.zeros(len(p)))
            for i in range(len(p)):
                if not letters[i] or not LETTER.search(p.data[p.offsets[i] : p.offsets[i + 1]].tobytes().decode("utf-8", "replace")) or not model.languages:
                    lang.append("und")
                    gain.append(0.0)
                    continue
                best = int(np.argmax(bits[i]))
                lang.append(model.languages[best])
                gain.append(float(bits[i][best] / letters[i]))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(gain, pa.float64())], names=["lang_pred", "saved"])

    return F.arrow_udf(measure, "lang_pred string, saved double")(text)


def limits(docs: DataFrame, model: Model) -> dict[str, float]:
    """The savings that a text needs, by given language, from all labelled texts.

    Zero, or less where the labelled texts themselves save little: ``SPREADS``
    quartile distances below their median, which a few wrong labels cannot move.
    """
    told = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # Told apart in the sums: a filter would be moved below the projection and measure every text a second time, in a worker of its own.
    gain = F.when(F.col("p.lang_pred") != "und", F.col("p.saved"))
    gains = told.select("lang", saved(F.col("text"), model).alias("p")).select("lang", gain.alias("gain"))
    found = gains.groupBy("lang").agg(F.count("gain"), F.percentile_approx("gain", [0.25, 0.5], 10_000)).collect()
    return {lang: min(0.0, q[1] - SPREADS * (q[1] - q[0])) for lang, n, q in found if n >= LEAST_ROWS}


def filter_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that a learned language explains: a letter, and savings above the limit of the language that saves most.

    Models (of windows that at least ``SPREAD`` of a language's texts have) and limits
    are learned from the rows' own ``lang``. A text that no
    language codes better than the background does is noise, or of a language that was not learned.
    """
    model = fit(docs, spread=SPREAD)
    learned = limits(docs, model) if model.languages else {}
    limit = F.lit(0.0)
    if learned:
        table = F.create_map(*[F.lit(x) for pair in sorted(learned.items()) for x in pair])
        limit = F.coalesce(F.try_element_at(table, F.col("p.lang_pred")), limit)
    marked = docs.select(F.struct("*").alias("row"), saved(F.col("text").cast("string"), model).alias("p"))
    return marked.where((F.col("p.lang_pred") != "und") & (F.col("p.saved") > limit)).select("row.*")
