"""A partitioned suffix array over texts of hashed words, and what its neighbours share (problem 2).

Texts of one batch are concatenated; every wanted suffix is one entry with the first ``depth`` words behind its start,
32 bits of hash each.  Entries are partitioned by those words and sorted, so that neighbours whose common prefix is
``depth`` words long lie side by side in one partition.  The longest common prefix of every two neighbours is computed;
a stretch of neighbours with prefixes of ``depth`` words is one shared span.

Before the sort, one pass marks in two bitmaps of fixed size which spans the train side and the evaluation side have at
all: a span of one side only has no cross-split neighbour and is not sent.  The same pass counts spans in a table of fixed
size; texts under a span that is far too frequent are dealt by a further key (see :mod:`quillframe.llm.overlap`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of the bitmap of spans per side, and counters of the table of span counts; both travel with the second pass.
BITS, COUNTERS = 1 << 22, 1 << 18
#: Pieces in which tasks send their bitmaps, so that they are merged by many tasks.
PIECES = 64
#: Pairs that are looked at in one go.
BLOCK = 1 << 21

TRAIN, HELD = 0, 1


class Texts(NamedTuple):
    """A batch of texts as one concatenation: ``flat`` words, and for each its text, position, and the text's length."""

    flat: np.ndarray
    row: np.ndarray
    pos: np.ndarray
    size: np.ndarray
    sizes: np.ndarray


def concatenated(column: pa.Array) -> Texts:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return Texts(flat, row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes), sizes[row], sizes)


def heads(texts: Texts, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first ``depth`` words of the suffixes that start at ``at``, 32 bits of each, two words in a number."""
    word = (texts.flat.view(np.uint64) >> np.uint64(32)).astype(np.uint64)
    out = []
    for k in range(0, depth, 2):
        second = word[at + k + 1] if k + 1 < depth else np.zeros(len(at), np.uint64)
        out.append(((word[at + k] << np.uint64(32)) | second).view(np.int64))
    return out


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number of several."""
    x = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            x = (x ^ part.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
    return x


class Shared:
    """Which spans both sides have, and which are frequent."""

    def __init__(self, bits: np.ndarray, counts: np.ndarray, limit: int) -> None:
        self.bits = bits
        # A table of fixed size fills up; what counts as frequent grows with its mean.
        self.hot = counts > max(limit, 4 * int(counts.mean()))

    def both(self, span: np.ndarray) -> np.ndarray:
        b = (span & np.uint64(BITS - 1)).astype(np.int64)
        return (self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1

    def frequent(self, span: np.ndarray) -> np.ndarray:
        return self.hot[(span >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1)]


def shared(texts: DataFrame, spans: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], limit: int) -> Shared:
    """Bitmaps and counts of all spans; ``spans`` yields (side, spans) of a batch. What reaches the driver is 1 MB and a half."""
    fields = "piece int, train binary, held binary, n binary"
    names = [f.split()[0] for f in fields.split(", ")]
    width, part = BITS // 8 // PIECES, COUNTERS // PIECES

    def rows(bits: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        pack = [bits[s].reshape(PIECES, width) for s in (TRAIN, HELD)]
        n = counts.reshape(PIECES, part)
        used = [k for k in range(PIECES) if n[k].any() or pack[0][k].any() or pack[1][k].any()]
        columns = [pa.array(used, pa.int32()), *[pa.array([p[k].tobytes() for k in used], pa.binary()) for p in (*pack, n)]]
        return pa.RecordBatch.from_arrays(columns, names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((2, BITS // 8), np.uint8)
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for side, span in spans(batch):
                b = (span & np.uint64(BITS - 1)).astype(np.int64)
                np.bitwise_or.at(bits[side], b >> 3, np.uint8(1) << (b & 7).astype(np.uint8))
                counts += np.bincount((span >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1), minlength=COUNTERS)
        yield rows(bits, counts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((2, PIECES, width), np.uint8)
        counts = np.zeros((PIECES, part), np.int64)
        for batch in batches:
            for k, *packed in zip(*(batch.column(c).to_pylist() for c in names)):
                for s in (TRAIN, HELD):
                    bits[s, k] |= np.frombuffer(packed[s], np.uint8)
                counts[k] += np.frombuffer(packed[2], np.int64)
        yield rows(bits.reshape(2, -1), counts.ravel())

    merged = texts.mapInArrow(count, fields).repartition("piece").mapInArrow(merge, fields)
    bits = np.zeros((2, PIECES, width), np.uint8)
    counts = np.zeros((PIECES, part), np.int64)
    for r in merged.collect():
        bits[TRAIN, r.piece] |= np.frombuffer(r.train, np.uint8)
        bits[HELD, r.piece] |= np.frombuffer(r.held, np.uint8)
        counts[r.piece] += np.frombuffer(r.n, np.int64)
    return Shared((bits[TRAIN] & bits[HELD]).ravel(), counts.ravel(), limit)


def common_prefix(columns: list[np.ndarray], depth: int) -> np.ndarray:
    """Words in the longest common prefix of every entry and the one before it, at most ``depth``; 0 for the first."""
    n = len(columns[0])
    out = np.zeros(n, np.int32)
    same = np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        word = columns[k // 2].view(np.uint64)
        word = word >> np.uint64(32) if k % 2 == 0 else word & np.uint64(0xFFFFFFFF)
        same &= word[1:] == word[:-1]
        out[1:] += same
    return out


def cross_pairs(edge: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(held entry, train entry) of every shared span, in blocks; ``edge`` bounds the spans."""
    span = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    train, held = np.nonzero(side == TRAIN)[0], np.nonzero(side == HELD)[0]
    n = np.bincount(span[train], minlength=len(edge) - 1)
    first = np.cumsum(n) - n
    mine = n[span[held]]
    held, mine = held[mine > 0], mine[mine > 0]
    total = np.cumsum(mine)
    at = 0
    while at < len(held):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, side="right")))
        h, m = held[at:end], mine[at:end]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(h, m), train[np.repeat(first[span[h]], m) + inner]
        at = end
