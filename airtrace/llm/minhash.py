"""MinHash near-duplicates by a multi-index Hamming join.

A set's signature has ``SYMBOLS`` min-hashes of ``BITS`` bits. Two sets of
similarity s differ in a symbol with probability about 1 - s, so the Hamming
distance of their signatures tells candidates. The join is exact for distances
up to ``MAX_DISTANCE``: the signature is cut into ``CHUNKS`` chunks, and as
``MAX_DISTANCE < 2 * CHUNKS``, two such signatures differ in at most one symbol
of some chunk (pigeonhole). That error is enumerated: every chunk is a key once
for each of its symbols left out. Equal keys tie documents, the ties' components
are families, and a family's members meet block by block: Hamming distances over
the signature matrix first, then the overlap of the full sets for pairs that are
not yet of one class.

At 80 % the distance of two linked sets has mean 25.6 and deviation 4.5 of 128
symbols; 45 is passed by about 2 pairs in 100,000 that lie right at the
threshold. Such pairs mostly share a key all the same (they share none once in
10**11), so the check inside a family looks up to ``LOOSE`` symbols far.

Work per document is a fixed number of keys. Ties are streamed through range
partitions, so one key of very many documents is cut between tasks. A family
larger than a block is met block by block: its work, not a task's memory, grows
with the square of its blocks.

Defined results: null or empty texts (or no words) have no shingles and stay
alone; repeated rows of an id share its class, of several texts of one id too;
a null ``doc_id`` has a null class and links with nothing; an empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import graph_components
from ..session import materialize
from .jaccard import _ties
from .kernels import U, mix, pieces, shingle_sets
from .tables import texts

SYMBOLS, BITS, CHUNKS = 128, 16, 23
MAX_DISTANCE = 2 * CHUNKS - 1
LOOSE = 64
#: Elements of a block; a small set counts as ``LEAST``, for its signature.
BLOCK_ELEMENTS, LEAST = 1 << 21, 512
_CUTS = np.array_split(np.arange(SYMBOLS), CHUNKS)
_MULTIPLY = mix(np.arange(1, SYMBOLS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_FLIP = mix(np.arange(1, SYMBOLS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SYMBOLS`` symbols per set; empty sets have zeros."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(SYMBOLS):
            low = np.minimum.reduceat(flat * _MULTIPLY[k] ^ _FLIP[k], starts)
            out[full, k] = (mix(low) >> U(64 - BITS)).astype(np.uint16)
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` keys per row: every chunk with each of its symbols left out."""
    place = np.arange(1, SYMBOLS + 1, dtype=U) << U(BITS)
    terms = mix(signature.astype(U) + place)
    out = np.empty(signature.shape, U)
    for cut in _CUTS:
        out[:, cut] = mix(terms[:, cut].sum(1, dtype=U)[:, None] - terms[:, cut] + place[cut])
    return out


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, set size ``n``, digest ``d1, d2`` and signature ``sig``, a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b["text"]):
                sets = shingle_sets(p, words)
                d1 = np.array([np.add.reduce(mix(s), dtype=U) for s in sets], U).view(np.int64)
                d2 = np.array([np.add.reduce(mix(s + U(0x2545F4914F6CDD1D)), dtype=U) for s in sets], U).view(np.int64)
                n = pa.array([len(s) for s in sets], pa.int64())
                sig = pa.array([row.tobytes() for row in signatures(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(p.first, len(p)), n, pa.array(d1), pa.array(d2), sig], names=["doc_id", "n", "d1", "d2", "sig"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 4096):
            part = b.slice(a, 4096)
            rows = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            ids = np.repeat(part["doc_id"].to_numpy(), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys(rows).ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["sig", "doc_id"])


class Block:
    """Sets and signatures of one block; ``pairs`` finds a forest of the links between two sides."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], signature: np.ndarray):
        self.ids, self.signature = ids, signature
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.elements = flat, len(values)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def overlaps(self, i: int, others: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Number of elements that set ``i`` shares with each of the ``others``."""
        own = self.flat[self.first[i] : self.first[i + 1]]
        present[own] = 1
        size = self.sizes[others]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.repeat(self.first[others] - starts, size) + np.arange(size.sum())
        both = np.add.reduceat(present[self.flat[at]], starts, dtype=np.int64)
        present[own] = 0
        return both

    def pairs(self, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
        root = np.arange(len(self.ids))
        present = np.zeros(self.elements, np.uint8)
        matrix, sizes = self.signature[right], self.sizes[right]
        out = []
        for i in left:
            near = (matrix != self.signature[i]).sum(1) <= LOOSE
            n = self.sizes[i]
            near &= (den * np.minimum(sizes, n) >= num * np.maximum(sizes, n)) & (root[right] != root[i])
            others = right[near]
            if not len(others):
                continue
            both = self.overlaps(i, others, present)
            linked = others[den * both >= num * (n + self.sizes[others] - both)]
            for r in np.unique(root[linked]):
                out.append((self.ids[i], self.ids[r]))
                root[root == r] = root[i]
        return out


def _met(words: int, num: int, den: int):
    """Stream texts sorted by block (family, x, y) and find the links of each block when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, sides, sigs = None, [], [], [], []

        def links():
            found = []
            side = np.array(sides)
            left, right = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])
            if len(sets) > 1 and len(left) and len(right):
                rows = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SYMBOLS)
                found = Block(ids, sets, rows).pairs(left, right, num, den)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("family", "x", "y", "side", "id", "sig")))
            for p in pieces(b["text"]):
                for own, (family, x, y, side, who, sig) in zip(shingle_sets(p, words), rows):
                    if (family, x, y) != key:
                        if key is not None:
                            yield links()
                        key, ids, sets, sides, sigs = (family, x, y), [], [], [], []
                    # An id with several texts comes with every pair of text and signature, the right ones among them.
                    ids.append(who)
                    sets.append(own)
                    sides.append(side)
                    sigs.append(sig)
        if key is not None:
            yield links()

    return run


def classes(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` per row of ``docs``.

    Two documents link when intersection / union of their shingle sets is at
    least ``num / den``; the class is the smallest id reachable by links.
    Signatures are laid out for 80 % and more.
    """
    if 10 * num < 8 * den:
        raise ValueError("signatures are laid out for a similarity of 0.8 or more")
    rows = materialize(_signed(docs, words), "signed")
    full = rows.where("n > 0 and doc_id is not null")
    equal = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    sets = materialize(equal, "sets")
    member = materialize(full.join(sets.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select("doc_id", "n", "rep", "d1", "d2").distinct(), "members")
    keyed = sets.select("sig", F.col("rep").alias("doc_id")).mapInArrow(_keyed, "sig long, doc_id long")
    families = graph_components(_ties(keyed)).select(F.col("node").alias("rep"), F.col("label").alias("family"))
    placed = materialize(families.join(sets, "rep"), "families")
    sizes = placed.groupBy("family").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / BLOCK_ELEMENTS).cast("int").alias("blocks"), F.count("*").alias("sets"))
    side = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    wanted = placed.join(sizes.where("sets > 1"), "family").select(F.col("rep").alias("doc_id"), "family", "blocks", side.alias("side"), "sig")
    met = (
        texts(docs).join(wanted.hint("merge"), "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", F.col("doc_id").alias("id"), "sig", "text")
    )
    arranged = met.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "id")
    links = arranged.mapInArrow(_met(words, num, den), "a long, b long")
    # A representative is tied to itself, so that texts of repeated ids meet in one class too.
    every = links.unionByName(member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = graph_components(every).select(F.col("node").alias("doc_id"), F.col("label").alias("component_id"))
    return (
        rows.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
