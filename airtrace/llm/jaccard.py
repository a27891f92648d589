"""N-gram Jaccard join by prefix tree.

Exact: every pair of documents whose shingle sets reach the threshold ends in
the same class. The work is cut in four steps, none of which lists the pairs
of a group:

1. Equal sets collapse to one representative (grouped minimum, combined
   before the shuffle).
2. A set is cut by element hash into more parts than two linked sets of its
   size band can differ in, so linked sets agree on a whole part. Sets that
   agree on a part are tied in a star, and the ties' components are families.
   Elements that are common in a sample are left out of the parts, so that a
   passage of many documents ties none; this changes no link. The sample is a
   fixed share of a large table: what is shared by a hundred documents is left
   out at every size, else chance ties would join most sets to one family.
3. A family's sets are stored in radix tries, common elements first, at most
   about ``BLOCK_ELEMENTS`` elements per trie. A set walks each trie of its
   family level by level, sharing the overlap of common paths, and leaves
   subtrees that the remaining lengths rule out. Larger families are met
   trie by trie, so a task holds two blocks whatever the family's size.
4. The links found, as local forests, are joined to classes.

Set elements are 64-bit shingle hashes, equal sets are told by 128-bit sums.

Defined results: null or empty texts (or no words) have no elements and stay
alone; repeated rows of an id share its class; rows with a null ``doc_id`` have
a null class and link with nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import graph_components
from ..session import discard, materialize
from .kernels import U, mix, pieces, shingle_sets
from .tables import texts

BLOCK_ELEMENTS = 1 << 21
#: Upper ends of a size band are this fraction apart (numerator, denominator).
BAND = (4, 5)
#: Sample in which common elements are looked for (documents, and one of so many where that is more), and the documents of it that make one common.
SAMPLE_DOCS, SAMPLE_SHARE, SAMPLE_DF = 20_000, 12, 5
#: Leading hash bits that name a common element, least and most: 8 MB of flags, at most an eighth of them set.
COMMON_BITS, MOST_BITS = 24, 26
_TOP = 1 << 40


def _bands() -> np.ndarray:
    """Largest set size of every band, ascending."""
    tops = [1]
    while tops[-1] < _TOP:
        tops.append(max(tops[-1] + 1, tops[-1] * BAND[1] // BAND[0]))
    return np.array(tops)


TOPS = _bands()


def _schemes(n: int, num: int, den: int) -> list[int]:
    """Bands in which a set of ``n`` elements meets others: its own, and higher ones that a linked set may be in."""
    own = int(np.searchsorted(TOPS, n))
    largest = n * den // num
    out = [own]
    while TOPS[out[-1]] < largest:
        out.append(out[-1] + 1)
    return out


def _part_counts(scheme: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of parts in a scheme, and how many of them may be empty before a set counts as thin.

    Linked sets up to the band's top differ in at most ``differ`` elements, so
    of ``differ + 1 + spare`` parts more than ``spare`` are equal. A set with at
    most ``spare`` empty parts therefore shares a part that is not empty.
    """
    differ = 2 * TOPS[scheme] * (den - num) // (den + num)
    spare = 2 + (differ + 1) // 8
    return differ + 1 + spare, spare


def _cut(sets: list[np.ndarray], scheme: np.ndarray, num: int, den: int, space: int, thin_only: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Part hashes of every entry and whether it is thin; empty parts are given for thin entries on request."""
    parts, spare = _part_counts(scheme, num, den)
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate([*sets, np.zeros(0, U)])
    spread = mix(elements ^ U(0x5851F42D4C957F2D))
    first = np.concatenate([[0], np.cumsum(parts)])
    part = np.repeat(first[:-1], sizes) + ((spread >> U(33)) % np.repeat(parts, sizes).astype(U)).astype(np.int64)
    sums = np.zeros(first[-1], U)
    np.add.at(sums, part, spread)
    empty = np.bincount(part, minlength=first[-1]) == 0
    number = np.arange(first[-1]) - np.repeat(first[:-1], parts)
    tags = number.astype(U) * U(0xAEF17502108EF2D9) + np.repeat(scheme, parts).astype(U) * U(2) + U(space)
    sums = mix(sums * U(0xD1342543DE82EF95) + mix(tags))
    empties = np.add.reduceat(empty, first[:-1], dtype=np.int64) if len(parts) else np.zeros(0, np.int64)
    thin = empties > spare
    keep = ~empty | (np.repeat(thin, parts) & thin_only)
    return [sums[x:y][keep[x:y]] for x, y in zip(first[:-1], first[1:])], thin


def _signatures(sets: list[np.ndarray], num: int, den: int, common: np.ndarray) -> list[np.ndarray]:
    """Hashes of the parts of every set, over all its schemes.

    Parts are cut from what is left of a set without the common elements, which
    only lowers the number of elements that two sets differ in. Sets that are
    thin then (made mostly of common elements) are also cut whole, so two
    linked sets share a part in either way, whichever elements are common.
    """
    owner = [(i, k) for i, s in enumerate(sets) if len(s) for k in _schemes(len(s), num, den)]
    out: list[list[np.ndarray]] = [[] for _ in sets]
    if owner:
        rest = [s[~_flagged(common, s)] for s in sets]
        scheme = np.array([k for _, k in owner])
        sums, thin = _cut([rest[i] for i, _ in owner], scheme, num, den, 0, False)
        for (i, _), own in zip(owner, sums):
            out[i].append(own)
        again = [x for x, t in zip(owner, thin) if t]
        if again:
            sums, _ = _cut([sets[i] for i, _ in again], np.array([k for _, k in again]), num, den, 1, True)
            for (i, _), own in zip(again, sums):
                out[i].append(own)
    return [np.concatenate(x) if x else np.zeros(0, U) for x in out]


def _flagged(flags: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Whether the leading bits of each element have their flag; ``flags`` are words of 64."""
    at = elements >> U(64 - (64 * len(flags) - 1).bit_length())
    return (flags[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)


def _common(docs: DataFrame, total: int, words: int) -> np.ndarray:
    """Flags, by leading hash bits, of elements that several documents of a sample have.

    Any flags give the same links; those of frequent passages keep documents
    apart that share nothing else. Where the flags do not hold all such
    elements, those of the most documents are flagged.
    """
    share = min(1.0, max(SAMPLE_DOCS / max(1, total), 1 / SAMPLE_SHARE))
    drawn = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(share * 1_000_003))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b["text"]):
                flat = np.concatenate([*shingle_sets(p, words), np.zeros(0, U)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["element"])

    counts = drawn.mapInArrow(run, "element long").groupBy("element").agg(F.least(F.count("*"), F.lit(1 << 10)).alias("docs"))
    shared = materialize(counts.where(F.col("docs") >= SAMPLE_DF), "common")
    known = sorted(((r["docs"], r["count"]) for r in shared.groupBy("docs").count().collect()), reverse=True)
    bits = max(COMMON_BITS, min(MOST_BITS, (8 * sum(n for _, n in known)).bit_length()))
    least, room = SAMPLE_DF, (1 << bits) // 8
    for df, n in known:
        room -= n
        if room < 0:
            least = df + 1
            break
    at = shared.where(F.col("docs") >= least).select(F.shiftrightunsigned("element", 64 - bits).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("flags")).toPandas()
    discard(shared)
    flags = np.zeros(1 << bits - 6, U)
    flags[found["word"].to_numpy(np.int64)] = found["flags"].to_numpy(np.int64).view(U)
    return flags


def _equal_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, set size ``n`` and digest ``d1, d2``, a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b["text"]):
                sets = shingle_sets(p, words)
                d1 = np.array([np.add.reduce(mix(s), dtype=U) for s in sets], U).view(np.int64)
                d2 = np.array([np.add.reduce(mix(s + U(0x2545F4914F6CDD1D)), dtype=U) for s in sets], U).view(np.int64)
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(p.first, len(p)), n, pa.array(d1), pa.array(d2)], names=["doc_id", "n", "d1", "d2"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def _parts(docs: DataFrame, words: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """``sig`` and ``doc_id``: a row for every part of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b["text"]):
                sigs = _signatures(shingle_sets(p, words), num, den, common)
                ids = b["doc_id"].slice(p.first, len(p)).to_numpy(zero_copy_only=False)
                flat = np.concatenate([*sigs, np.zeros(0, U)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(ids, [len(s) for s in sigs]), pa.int64())], names=["sig", "doc_id"])

    return texts(docs).where("doc_id is not null").mapInArrow(run, "sig long, doc_id long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (sig, doc_id): a tie of each id to the first of its run, and the first and last run itself."""

    def out(a, b, sig=None):
        sigs = pa.nulls(len(a), pa.int64()) if sig is None else pa.array([sig], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), sigs], names=["a", "b", "sig"])

    run = None  # sig and first id of the run that is being read
    for b in batches:
        if not b.num_rows:
            continue
        sig, ids = b["sig"].to_numpy(), b["doc_id"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[run is None or sig[0] != run[0]], sig[1:] != sig[:-1]]))
        if run is None:
            yield out([ids[0]], [ids[0]], sig[0])
        heads = np.concatenate([[] if len(starts) and starts[0] == 0 else [run[1]], ids[starts]]).astype(np.int64)
        low = np.repeat(heads, np.diff([*([0] if len(heads) > len(starts) else []), *starts, len(sig)]))
        tied = np.unique(np.stack([ids, low], 1)[ids != low], axis=0)
        yield out(tied[:, 0], tied[:, 1])
        run = (sig[-1], heads[-1])
    if run is not None:
        yield out([run[1]], [run[1]], run[0])


def _ties(sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) that tie every document of a part hash to one of them.

    Range partitions may cut a hash with very many documents; the runs at the
    partitions' ends, two a partition, are tied in a second step.
    """
    arranged = sigs.repartitionByRange("sig", "doc_id").sortWithinPartitions("sig", "doc_id")
    found = materialize(arranged.mapInArrow(_runs, "a long, b long, sig long"), "ties")
    ends = found.where("sig is not null")
    low = ends.groupBy("sig").agg(F.min("b").alias("low"))
    across = ends.join(low, "sig").where("a <> low").select("a", F.col("low").alias("b"))
    return found.where("sig is null").select("a", "b").unionByName(across)


class Trie:
    """Radix trie of sets of ranks, kept level by level.

    A node is a run of ranks (at most 16 at the root, 64 further down) that all sets below it share; ``low`` and
    ``high`` are the least and greatest set sizes below, ``depth`` the ranks
    down to its end, ``last`` its highest rank and ``leaf`` a set's index or -1.
    A level's nodes are ordered by parent, so children are ranges.
    """

    def __init__(self, sets: list[np.ndarray], ranks: int):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        rows = [sets[i] for i in order]
        common = []
        for a, b in zip(rows, rows[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        # An interval a..b of sorted rows that share ``start`` ranks; its children are cut where neighbours share no more than its end.
        level = [(0, len(rows), 0, 0)]
        self.levels: list[tuple] = []
        while level:
            width = min(16 << len(self.levels), 64)
            parents, runs, depths, last, low, high, leaf, below = [], [], [], [], [], [], [], []
            for a, b, start, parent in level:
                shared = min(common[a : b - 1]) if b - a > 1 else len(rows[a])
                end = min(shared, start + width)
                run = np.full(width, ranks)
                run[: end - start] = rows[a][start:end]
                sizes = [len(r) for r in rows[a:b]]
                done = b - a == 1 and end == shared
                me = len(parents)
                parents.append(parent)
                runs.append(run)
                depths.append(end)
                last.append(int(rows[a][end - 1]) if end else -1)
                low.append(min(sizes))
                high.append(max(sizes))
                leaf.append(order[a] if done else -1)
                if end < shared:
                    below.append((a, b, end, me))
                elif not done:
                    cuts = [a, *(a + 1 + j for j, c in enumerate(common[a : b - 1]) if c == shared), b]
                    below += [(x, y, end, me) for x, y in zip(cuts, cuts[1:])]
            first = np.searchsorted(np.array(parents), np.arange(1 + max(parents, default=0) + 1))
            self.levels.append((first, *map(np.array, (runs, depths, last, low, high, leaf))))
            level = below

    def search(self, ranks: np.ndarray, present: np.ndarray, num: int, den: int) -> np.ndarray:
        """Indices of the sets whose overlap with ``ranks`` (flags: ``present``) reaches the threshold."""
        n, both = len(ranks), num + den
        alive, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        for first, runs, depth, last, low, high, leaf in self.levels:
            inside = alive < len(first) - 1
            alive, overlap = alive[inside], overlap[inside]
            a, b = first[alive], first[alive + 1]
            count = b - a
            nodes = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else a
            if not len(nodes):
                break
            sums = np.repeat(overlap, count) + present[runs[nodes]].sum(1)
            rest = n - np.searchsorted(ranks, last[nodes], "right")
            lo, hi = low[nodes], high[nodes]
            stay = (both * (sums + rest) >= num * (n + lo)) & (both * (sums + hi - depth[nodes]) >= num * (n + hi))
            alive, overlap = nodes[stay], sums[stay]
            ends = leaf[alive] >= 0
            sized = depth[alive[ends]]
            found.append(leaf[alive[ends]][both * overlap[ends] >= num * (n + sized)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _forest(ids: list[int], sets: list[np.ndarray], left: list[int], right: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links between the sets at ``left`` and at ``right`` as (id, smaller id) pairs of a forest."""
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    ranked = [np.sort(rank[np.searchsorted(values, s)]) for s in sets]
    trie = Trie([ranked[i] for i in right], len(values))
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    present = np.zeros(len(values) + 1, bool)
    for i in left:
        present[ranked[i]] = True
        for j in trie.search(ranked[i], present, num, den).tolist():
            a, b = top(i), top(right[j])
            if a != b:
                root[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
        present[ranked[i]] = False
    return [(ids[i], ids[top(i)]) for i in range(len(sets)) if top(i) != i]


def _joined(words: int, num: int, den: int):
    """Stream texts sorted by block (family, x, y) and join the sets of each block when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, sides = None, [], [], []

        def links():
            left = [i for i, s in enumerate(sides) if s == key[1]]
            right = left if key[1] == key[2] else [i for i, s in enumerate(sides) if s == key[2]]
            pairs = _forest(ids, sets, left, right, num, den) if len(sets) > 1 and left and right else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("family", "x", "y", "side", "id")))
            for p in pieces(b["text"]):
                for own, (family, x, y, side, who) in zip(shingle_sets(p, words), rows):
                    if (family, x, y) != key:
                        if key is not None:
                            yield links()
                        key, ids, sets, sides = (family, x, y), [], [], []
                    ids.append(who)
                    sets.append(own)
                    sides.append(side)
        if key is not None:
            yield links()

    return run


def classes(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` per row of ``docs``.

    Two documents link when intersection / union of their shingle sets is at
    least ``num / den``; the class is the smallest id reachable by links.
    """
    rows = materialize(_equal_sets(docs, words), "equal_sets")
    full = rows.where("n > 0 and doc_id is not null")
    equal = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    member = materialize(full.join(equal, ["d1", "d2", "n"]).select("doc_id", "n", "rep").distinct(), "members")
    ties = _ties(_parts(docs, words, num, den, _common(docs, rows.count(), words)))
    tied = graph_components(ties)
    discard(ties)
    families = tied.select(F.col("node").alias("doc_id"), F.col("label").alias("family"))
    placed = materialize(families.join(member.where("doc_id = rep").select("doc_id", "n"), "doc_id"), "families")
    discard(tied)
    sizes = placed.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"), F.count("*").alias("sets"))
    side = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    wanted = placed.join(sizes.where("sets > 1"), "family").select("doc_id", "family", "blocks", side.alias("side"))
    met = (
        texts(docs).join(wanted.hint("merge"), "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", F.col("doc_id").alias("id"), "text")
    )
    arranged = met.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "id")
    links = arranged.mapInArrow(_joined(words, num, den), "a long, b long")
    # A representative is tied to itself, so that texts of repeated ids meet in one class too.
    every = links.unionByName(member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = graph_components(every).select(F.col("node").alias("doc_id"), F.col("label").alias("component_id"))
    discard(placed)
    return (
        rows.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )
