"""Array kernels over the UTF-8 bytes of many texts at once.

Every function works on whole texts: a *piece* is a run of consecutive rows
whose texts lie in one byte buffer, cut only between rows, so memory follows
the longest single text and never the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
U = np.uint64
#: White space of the contracts: blank and the five control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


@dataclass
class Piece:
    """Bytes of rows ``first .. first + n`` of a batch; row i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into pieces of about ``limit`` bytes; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        own = offsets[first : last + 1]
        yield Piece(first, data[own[0] : own[-1]], own - own[0])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (multiply and shift)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        factor = U(BASE if kind == "up" else BASE_INV)
        row = np.full(max(n, PIECE_BYTES + 1), factor, U)
        row[0] = 1
        have = _powers[kind] = np.multiply.accumulate(row)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[starts[i]:ends[i]]``."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power("up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


@dataclass
class Words:
    """Maximal runs of non-space bytes of a piece; ``bounds`` cuts them by row."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(piece: Piece) -> Words:
    solid = np.zeros(len(piece.data) + 2, bool)
    solid[1:-1] = ~SPACE[piece.data]
    start = solid[1:-1] & ~solid[:-2]
    end = solid[1:-1] & ~solid[2:]
    inner = piece.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(piece.data))]
    start[inner] |= solid[inner + 1]
    end[inner - 1] |= solid[inner]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, piece.offsets))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive values; the caller drops those that cross rows."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, U)
    for j in range(size):
        out = mix(out * U(0x9FB21C651E98DF25) + hashes[j : j + n])
    return out


def shingle_sets(piece: Piece, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles, A-Z lower-cased.

    A row with fewer words has the whole sequence as its only element, a row
    without words has none.
    """
    found = words(piece)
    hashes = span_hashes(LOWER[piece.data], found.starts, found.ends)
    windows = window_hashes(hashes, size)
    out = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if b - a >= size:
            one = np.sort(windows[a : b - size + 1])
            keep = np.ones(len(one), bool)
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, U))
    return out
