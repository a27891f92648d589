"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a white-space marker behind another character
(checked when the model is opened), so merges never cross the start of a marker
run. Texts are cut there, a slice of texts at a time. Its distinct chunks (markers
and the characters up to the next marker) are looked up in a table that a worker
keeps, the unknown ones are segmented in one call and their ids decoded by the
library in another, and ids and decoded strings are joined back by position.

Defined results: null and empty texts have the end id alone and decode to the
empty string; repeated rows each get a result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import Piece, pieces

MARK = "▁"
#: Distinct chunks of each of the two generations that a worker remembers.
MEMORY = 120_000
#: A chunk of more characters is segmented with its slice and not remembered.
LONG = 64
#: Bytes of text that are cut, segmented and joined at a time (a slice has at least one text).
SLICE_BYTES = 2 << 20


class ChunkTable:
    """``chunk -> (ids, decoded)`` of chunks without their first marker.

    ``decoded`` is what the library decodes the ids to. Chunks lie in two
    generations. A chunk that is met again moves to the young one; when that is
    full, it becomes the old one and the chunks not met since are let go. So
    frequent chunks stay for good, however many there are.
    """

    def __init__(self, processor):
        self.processor = processor
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def segment(self, chunks: list[str]) -> Iterator[tuple[list[int], str]]:
        # The library puts a marker before what it encodes, and takes one blank from what it decodes. A marker
        # that ends a text is a chunk without characters.
        coded = [ids if c else [self.processor.piece_to_id(MARK)] for c, ids in zip(chunks, self.processor.encode(chunks, num_threads=1) if chunks else [])]
        yield from zip(coded, self.processor.decode(coded, num_threads=1) if coded else [])

    def look_up(self, chunks: list[str]) -> list[tuple[list[int], str]]:
        """Entries of distinct chunks; unknown ones are segmented in one call."""
        young, old = self.young, self.old
        found = [young.get(c) or old.get(c) for c in chunks]
        missing = [i for i, f in enumerate(found) if f is None]
        for i, entry in zip(missing, self.segment([chunks[i] for i in missing])):
            found[i] = entry
        young.update((c, f) for c, f in zip(chunks, found) if len(c) <= LONG)
        if len(young) >= MEMORY:
            self.young, self.old = {}, young
        return found


class Codec:
    """A SentencePiece model file, opened once per worker process."""

    _open: dict[str, Codec] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.processor.id_to_piece(i) for i in range(len(self.processor))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"pieces of {path} cross white-space markers")
        if self.processor.encode_as_pieces(" a") not in (["▁▁", "a"], ["▁", "▁a"]):
            raise ValueError(f"{path} changes white space")
        self.end = self.processor.eos_id()
        self.table = ChunkTable(self.processor)

    @staticmethod
    def open(path: str) -> Codec:
        if path not in Codec._open:
            Codec._open[path] = Codec(path)
        return Codec._open[path]

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids with the end id of all texts in a row, their number per text, and the texts that they decode to."""
        data, offsets = piece.data, piece.offsets
        starts = chunk_starts(data, offsets)
        cut = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        code, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        # A text's own first marker joins the library's, so such a chunk is another entry than the same one inside a text.
        rows = np.searchsorted(starts, offsets)
        leading = rows[:-1][rows[:-1] < rows[1:]]
        leading = leading[[chunks[c].startswith((" ", MARK)) for c in code[leading]]]
        own, code[leading] = np.unique(code[leading], return_inverse=True)
        inside = np.ones(len(code), bool)
        inside[leading] = False
        code[inside] += len(own)
        names = [MARK + chunks[c][1:] for c in own] + [(c[1:] if c.startswith((" ", MARK)) else c) for c in chunks]
        entries = self.table.look_up([c.replace(" ", MARK) for c in names])
        # The end id is the entry after the last and follows the last chunk of every text.
        code = np.insert(code, rows[1:], len(entries))
        counts = np.diff(rows) + 1
        sizes = np.fromiter(chain(map(len, (e[0] for e in entries)), (1,)), np.int64, len(entries) + 1)
        flat = np.fromiter(chain(chain.from_iterable(e[0] for e in entries), (self.end,)), np.int32, sizes.sum())
        size = sizes[code]
        ends = np.cumsum(size)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[code] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        first = np.cumsum(counts) - counts
        # A text's decoded chunks stand in a row, with the blank of the marker before all but its first one.
        inner = np.ones(len(code), bool)
        inner[first] = False
        inner[first + counts - 1] = False  # the end id decodes to nothing
        words = [e[1] for e in entries]
        spoken = pa.array([*words, "", *(" " + w for w in words)], pa.large_utf8()).take(pa.array(code + inner * (len(entries) + 1)))
        bounds = np.frombuffer(spoken.buffers()[1], np.int64)[: len(code) + 1]
        edges = np.append(bounds[first], bounds[-1])
        decoded = pa.Array.from_buffers(pa.large_utf8(), len(piece), [None, pa.py_buffer(edges), spoken.buffers()[2]]).to_pylist()
        return ids, np.add.reduceat(size, first) if len(first) else size, decoded


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: at a text's first byte, and at every marker (or blank) behind another character."""
    marker = np.zeros(len(data) + 3, bool)
    marker[: len(data)] = data == 0x20
    after = np.zeros(len(data) + 3, bool)  # bytes right behind a marker
    after[1:] = marker[:-1]
    if len(data) > 2:
        long = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        marker[: len(data) - 2] |= long
        after[3 : len(data) + 1] |= long
    start = marker & ~after
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(start[: len(data)])


def encoded(text: Column, model_path: str) -> Column:
    """Struct ``ids`` (with the end id) and ``decoded`` of a text column."""

    def run(column: pa.Array) -> pa.Array:
        codec = Codec.open(model_path)
        parts = [codec.encode(p) for p in pieces(column, SLICE_BYTES)]
        ids = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
        offsets = np.cumsum(np.concatenate([[0], *(p[1] for p in parts)])).astype(np.int32)
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array([t for p in parts for t in p[2]], pa.string())], names=["ids", "decoded"]
        )

    return F.arrow_udf(run, "ids array<int>, decoded string")(text)
