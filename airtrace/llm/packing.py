"""Cost-balanced packing of token sequences.

A document's ids fill whole sequences first; its tail competes for the rest.
Tails of a window are taken longest first, and each goes to the sequence of
lowest cost (linear plus quadratic attention cost of the pieces in it) that has
room, being cut where the room ends. The room of a window equals its tokens:
sequences of full capacity, and for the remainder sequences whose lengths are
powers of two, which need no padding.

Tokenizing and packing run in one pass over the input partitions without a
shuffle: a window is at most ``WINDOW_TOKENS`` tail tokens, and a sequence id is
the partition number and a running number, so a task that is run again on the
same rows gives the same ids.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; a null ``doc_id`` stays null; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tables import texts

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
WINDOW_TOKENS = 1 << 22
#: Texts beyond this many characters are tokenized in parts that no token crosses.
PART_CHARS = 1 << 16
#: A blank between two other characters always starts a token of the byte-level pattern.
SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Runs beyond this length go to the merger whose time does not grow with their square.
LONG_RUN = 2000
LONG_BLANK = re.compile(r"\s{%d}" % LONG_RUN)


def _parts(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        seam = SEAM.search(text, at + PART_CHARS)
        if seam is None:
            break
        out.append(text[at : seam.start()])
        at = seam.start()
    return [*out, text[at:]]


def _byte_signs() -> dict[str, int]:
    """The printable sign of every byte in a byte-level vocabulary: itself, or the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of a public byte-level tokenizer file, opened once per worker process.

    The file's vocabulary is also loaded as merge ranks where ids follow the
    order of merges; that merger gives the same ids several times faster where a
    text has none of the file's added tokens.
    """

    _open: dict[str, Tokens] = {}

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        #: Strings that are one token wherever they stand in a text.
        self.added = [t["content"] for t in whole.get("added_tokens") or []]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranked = None
        if all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged)):
            import public_tokenizers
            import tiktoken

            signs = _byte_signs()
            ranks = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merged)}
            self.ranked = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def open(path: str) -> Tokens:
        if path not in Tokens._open:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            Tokens._open[path] = Tokens(path)
        return Tokens._open[path]

    def encode(self, text: str | None, end_id: int) -> np.ndarray:
        ids: list[int] = []
        text = text or ""
        # A text with an added token is left to the file's own tokenizer, whole.
        own = any(t in text for t in self.added)
        for part in [text] if own else _parts(text):
            if own or self.ranked is None or max(map(len, part.split()), default=0) > LONG_RUN or LONG_BLANK.search(part):
                ids += self.tokenizer.encode(part, add_special_tokens=False).ids
            else:
                ids += self.ranked.encode_ordinary(part)
        ids.append(end_id)
        return np.array(ids, np.uint32)


def assign(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (item, first, length) of every sequence that holds the items; sequences have no gaps."""
    total = sum(lengths)
    rooms = [capacity] * (total // capacity)
    rooms += [1 << k for k in range(capacity.bit_length(), -1, -1) if total % capacity >> k & 1]
    out: list[list[tuple[int, int, int]]] = [[] for _ in rooms]
    heap = [(0.0, i) for i in range(len(rooms))]
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = 0
        while at < lengths[item]:
            cost, i = heapq.heappop(heap)
            n = min(rooms[i], lengths[item] - at)
            out[i].append((item, at, n))
            at += n
            rooms[i] -= n
            if rooms[i]:
                heapq.heappush(heap, (cost + LINEAR * n + QUADRATIC * n * n, i))
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place: one row per piece.

    ``doc_id``, ``start`` (ids of the document before the piece), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``,
    ``offset`` in the sequence and ``cost`` of the piece.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.open(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        tails: list[tuple[int | None, int, np.ndarray, int]] = []
        held = 0

        def add(doc_id, start, ids, total, number, offset):
            rows.append((doc_id, start, len(ids), ids.tobytes(), total, number, offset, LINEAR * len(ids) + QUADRATIC * len(ids) ** 2))

        def flush():
            nonlocal sequence
            for pieces in assign([len(t[2]) for t in tails], capacity):
                offset = 0
                for item, first, n in pieces:
                    doc_id, start, ids, total = tails[item]
                    add(doc_id, start + first, ids[first : first + n], total, sequence, offset)
                    offset += n
                sequence += 1
            tails.clear()

        def ready():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = tokens.encode(text.as_py(), end_id)
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    add(doc_id, start, ids[start : start + capacity], len(ids), sequence, 0)
                    sequence += 1
                if whole < len(ids):
                    tails.append((doc_id, whole, ids[whole:], len(ids)))
                    held += len(ids) - whole
                if held >= WINDOW_TOKENS:
                    flush()
                    held = 0
                if len(rows) >= 2048:
                    yield ready()
        flush()
        if rows:
            yield ready()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
    return texts(docs).mapInArrow(run, schema)
