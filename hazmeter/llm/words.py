"""Words of many texts at once, in numpy: where they begin and end, and their hashes.

Words are what ASCII blanks separate; hashes take A-Z for lower case. Texts come as one array of UTF-8 bytes and the
places where each begins (and the last one ends).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes worked on at once.
PIECE = 1 << 19

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, as one array, and where each text begins and the last one ends."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8), at.astype(np.int64)


def pieces(column: pa.Array):
    """(first row, end row, bytes, edges) of ranges of rows of about PIECE bytes each."""
    if not len(column):
        return
    data, offsets = utf8(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(a: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word of ``a``; texts lie between consecutive ``edges``."""
    word = ~BLANK[a]
    before, behind = np.r_[False, word[:-1]], np.r_[word[1:], False]
    inner = edges[(edges > 0) & (edges < len(a))]
    before[inner], behind[inner - 1] = False, False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~behind) + 1
    return start, end, np.searchsorted(edges, start, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: its polynomial modulo 2^64 from differences of one running sum."""
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(len(a) + 1, base, dtype=np.uint64)
        p[0] = 1
        powers.append(np.cumprod(p))
    total = np.r_[np.uint64(0), np.cumsum((FOLD[a].astype(np.uint64) + np.uint64(1)) * powers[0][:-1])]
    return mixed((total[end] - total[start]) * powers[1][start] + (end - start).astype(np.uint64))
