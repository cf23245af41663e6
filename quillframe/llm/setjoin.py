"""Exact set-similarity self-join with block skipping and answer derivation (problems 2 and 5).

Records are sets of words.  One fixed total order of the words (rarest first, by a bounded frequency sketch) makes
every set a sequence; two sets with Jaccard similarity of at least ``t`` share a word among the first
``n - ceil(t * n) + 1`` words of both.  Those words are the keys of an inverted index.  A key whose list is longer than
``list_limit`` is replaced by pairs (word, later word): two similar sets share at least two words among one more word
of the prefix, so nothing is lost, and hot words split into many short lists.  Sets so small that one common word can be
enough (``t * n <= 1``) keep the single word as a key besides.  Lists that are still long are salted into a triangle of
sub-lists.  Within a list, entries lie in blocks ordered by set size and position; a pair of blocks
whose size range or best possible overlap cannot reach the threshold is skipped as a whole.  What is left is compared
by 512-bit signatures: the bits that differ never outnumber the words that differ.  Entries whose signature is close
to a block leader's take their candidates from the leader's answers by the triangle inequality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import SKETCH_BUCKETS, grouped, histogram

SIGNATURE_BITS = 512
BLOCK = 256
#: Words of the sequence kept after a key, for ordering suffixes.
TAIL = 4
#: A list longer than this is split by a second word, then salted.
LIST_LIMIT = 20_000
#: Entries this near to a leader (in signature bits) reuse its answers.
NEAR = 24


def distinct_sets(records: DataFrame, id_column: str, words_column: str, least: int) -> DataFrame:
    """(id, set_id, words): records with at least ``least`` distinct words; equal sets share a set_id."""
    ordered = F.array_sort(F.col(words_column))
    kept = records.where(F.size(words_column) >= least).select(F.col(id_column).alias("id"), ordered.alias("words"))
    return kept.withColumn("set_id", F.xxhash64(F.array_join("words", " "))).select("id", "set_id", "words")


def sequences(sets: DataFrame) -> tuple[DataFrame, list[int]]:
    """(set_id, tokens ...): one row per distinct set with its words as 64-bit hashes, and the frequency sketch."""
    reps = sets.select("set_id", F.transform("words", lambda w: F.xxhash64(w)).alias("tokens")).dropDuplicates(["set_id"])
    return reps, histogram(reps.select(F.explode("tokens").alias("token")), "token")


def _rows(values: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return array.offsets.to_numpy(), array.values.to_numpy(zero_copy_only=False)[: array.offsets[-1].as_py()]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))).astype(np.int64)


def postings(reps: DataFrame, counts: list[int], t: float, list_limit: int, extra: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """The index, and whether some words were split.  Entries are (key, n, pos, set_id, sig, tail, level, *extra); ``tail`` holds the next words."""
    table = np.asarray(counts, np.int64)
    schema = "key long, n int, pos int, set_id long, sig binary, tail binary, level int" + "".join(f", {c} int" for c in extra)

    def order(tokens: np.ndarray) -> np.ndarray:
        return tokens[np.lexsort((tokens, table[np.mod(tokens, SKETCH_BUCKETS)]))]

    def build(hot: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                offsets, flat = _rows(batch.column("tokens"))
                ids = batch.column("set_id").to_numpy()
                more = [batch.column(c).to_numpy() for c in extra]
                out: list[list] = [[] for _ in range(7 + len(extra))]
                sigs, tails = [], []
                for i in range(len(ids)):
                    seq = order(flat[offsets[i] : offsets[i + 1]])
                    n = len(seq)
                    p = n - math.ceil(t * n - 1e-9) + 1
                    bits = np.zeros(SIGNATURE_BITS, np.uint8)
                    bits[np.mod(seq >> 7, SIGNATURE_BITS)] = 1
                    sig = np.packbits(bits).tobytes()
                    keys, pos, level, tail = [], [], [], []
                    heat = hot[np.mod(seq[:p], SKETCH_BUCKETS)] if hot is not None else np.zeros(p, bool)
                    alone = t * n <= 1 + 1e-9  # such a set may share one word only with a set as small
                    for j in range(min(p, n)):
                        if not heat[j] or alone:
                            keys.append(seq[j : j + 1])
                            pos.append(np.array([j]))
                            level.append(np.array([2 if heat[j] else 1]))
                            tail.append(seq[j + 1 : j + 1 + TAIL].tobytes())
                        if heat[j]:
                            later = seq[j + 1 : min(n, p + 1)]
                            keys.append(_mix(np.full(len(later), seq[j]), later))
                            pos.append(np.full(len(later), j))
                            level.append(np.full(len(later), 2))
                            tail += [seq[x + 1 : x + 1 + TAIL].tobytes() for x in range(j + 1, j + 1 + len(later))]
                    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                    m = len(k)
                    out[0].append(k)
                    out[1].append(np.full(m, n, np.int32))
                    out[2].append(np.concatenate(pos).astype(np.int32) if m else np.zeros(0, np.int32))
                    out[3].append(np.full(m, ids[i], np.int64))
                    sigs += [sig] * m
                    tails += tail
                    out[6].append(np.concatenate(level).astype(np.int32) if m else np.zeros(0, np.int32))
                    for x, c in enumerate(more):
                        out[7 + x].append(np.full(m, c[i], np.int32))
                cols = [np.concatenate(c) if c else None for c in out]
                arrays = [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(sigs, pa.binary()), pa.array(tails, pa.binary()), pa.array(cols[6])]
                arrays += [pa.array(c) for c in cols[7:]]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "pos", "set_id", "sig", "tail", "level", *extra])

        return run

    # The length of every list, as a sketch: hot buckets use pairs of words instead.
    first = reps.select("tokens")

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_BUCKETS, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, flat = _rows(batch.column("tokens"))
            for a, b in zip(offsets[:-1], offsets[1:]):
                seq = order(flat[a:b])
                p = len(seq) - math.ceil(t * len(seq) - 1e-9) + 1
                np.add.at(total, np.mod(seq[:p], SKETCH_BUCKETS), 1)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "c"])

    lengths = np.zeros(SKETCH_BUCKETS, np.int64)
    for b, c in first.mapInArrow(prefix, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).collect():
        lengths[b] = c
    hot = lengths > list_limit
    source = reps.select("set_id", "tokens", *extra)
    return source.mapInArrow(build(hot if hot.any() else None), schema), bool(hot.any())


def salted(index: DataFrame, split: bool, list_limit: int) -> DataFrame:
    """Add (cell_a, cell_b): lists beyond ``list_limit`` become a triangle of cells; each pair of entries meets once.

    Only lists of word pairs and of hot words of small sets can be that long, so without any (``split``) there is nothing to count.
    """
    if not split:
        return index.withColumn("cell_a", F.lit(0)).withColumn("cell_b", F.lit(0))
    lengths = histogram(index.where("level = 2").select("key"), "key")
    parts = [max(1, math.ceil(c / list_limit)) for c in lengths]
    if max(parts) == 1:
        return index.withColumn("cell_a", F.lit(0)).withColumn("cell_b", F.lit(0))
    widths = F.array(*[F.lit(x) for x in sorted(set(parts))])
    by = {x: i for i, x in enumerate(sorted(set(parts)))}
    spark = index.sparkSession
    small = spark.createDataFrame([(b, by[x]) for b, x in enumerate(parts) if x > 1], "b int, w int")
    tagged = index.withColumn("b", F.when(F.col("level") == 2, F.pmod("key", F.lit(SKETCH_BUCKETS)).cast("int")))
    tagged = tagged.join(F.broadcast(small), "b", "left").withColumn("cells", F.coalesce(F.get(widths, F.col("w")), F.lit(1)))
    mine = F.pmod(F.xxhash64("set_id"), F.col("cells")).cast("int")
    spread = tagged.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return spread.withColumn("cell_a", F.least("mine", "other")).withColumn("cell_b", F.greatest("mine", "other")).drop("b", "w", "cells", "other")


def _most(n_a: np.ndarray, n_b: np.ndarray, t: float) -> np.ndarray:
    """Words in which two sets of these sizes may differ at similarity ``t``."""
    both = n_a + n_b
    return both - 2 * np.ceil(t / (1 + t) * both - 1e-9)


def compare_list(n: np.ndarray, pos: np.ndarray, sig: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entry numbers of one list that the signatures cannot rule out; blocks that cannot match are skipped."""
    order = np.lexsort((pos, n))
    n, pos, sig = n[order].astype(np.float64), pos[order].astype(np.float64), sig[order]
    starts = list(range(0, len(n), BLOCK))
    left = n - pos
    for a in starts:
        x = slice(a, a + BLOCK)
        n_x, sig_x, left_x = n[x], sig[x], left[x]
        leader = int(len(n_x) // 2)
        near = np.bitwise_count(sig_x ^ sig_x[leader]).sum(1)
        followers = np.nonzero(near <= NEAR)[0] if len(n_x) > 2 else np.zeros(0, np.int64)
        derive = len(followers) > 8
        for b in starts:
            if b < a:
                continue
            y = slice(b, b + BLOCK)
            n_y = n[y]
            if n_x[-1] < t * n_y[0]:
                break
            need = math.ceil(t / (1 + t) * (n_x[0] + n_y[0]) - 1e-9)
            if min(left_x.max(), left[y].max()) < need:
                continue
            sig_y = sig[y]
            rows = np.arange(len(n_x))
            if derive:
                answers = np.bitwise_count(sig_y ^ sig_x[leader]).sum(1)
                # The largest difference allowed does not grow evenly with the sizes, so every pair of sizes counts.
                slack = near[followers].max() + _most(np.unique(n_x[followers])[:, None], np.unique(n_y)[None, :], t).max()
                columns = np.nonzero(answers <= slack)[0]
                yield from _block(followers, columns, n_x, n_y, left_x, left[y], sig_x, sig_y, a, b, order, t)
                rows = np.setdiff1d(rows, followers)
            yield from _block(rows, np.arange(len(n_y)), n_x, n_y, left_x, left[y], sig_x, sig_y, a, b, order, t)


def compare_two(a: np.ndarray, b: np.ndarray, n: np.ndarray, pos: np.ndarray, sig: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one entry of ``a`` and one of ``b`` (entry numbers of a list) that the filters cannot rule out."""
    a, b = (x[np.lexsort((pos[x], n[x]))] for x in (a, b))
    left = (n - pos).astype(np.float64)
    size = n.astype(np.float64)
    for i in range(0, len(a), BLOCK):
        x = a[i : i + BLOCK]
        for j in range(0, len(b), BLOCK):
            y = b[j : j + BLOCK]
            if size[x[-1]] < t * size[y[0]]:
                break
            if size[y[-1]] < t * size[x[0]]:
                continue
            need = math.ceil(t / (1 + t) * (size[x[0]] + size[y[0]]) - 1e-9)
            if min(left[x].max(), left[y].max()) < need:
                continue
            differ = np.zeros((len(x), len(y)), np.uint16)
            for w in range(sig.shape[1]):
                differ += np.bitwise_count(sig[x, w][:, None] ^ sig[y, w][None, :])
            r, c = np.nonzero(differ <= _most(size[x][:, None], size[y][None, :], t))
            keep = np.minimum(left[x[r]], left[y[c]]) >= np.ceil(t / (1 + t) * (size[x[r]] + size[y[c]]) - 1e-9)
            if keep.any():
                yield x[r[keep]], y[c[keep]]


def _block(rows, columns, n_x, n_y, left_x, left_y, sig_x, sig_y, a, b, order, t):
    if not len(rows) or not len(columns):
        return
    differ = np.zeros((len(rows), len(columns)), np.uint16)
    for w in range(sig_x.shape[1]):
        differ += np.bitwise_count(sig_x[rows, w][:, None] ^ sig_y[columns, w][None, :])
    i, j = np.nonzero(differ <= _most(n_x[rows][:, None], n_y[columns][None, :], t))
    i, j = rows[i], columns[j]
    keep = (i + a) < (j + b)
    i, j = i[keep], j[keep]
    need = np.ceil(t / (1 + t) * (n_x[i] + n_y[j]) - 1e-9)
    keep = np.minimum(left_x[i], left_y[j]) >= need
    if keep.any():
        yield order[i[keep] + a], order[j[keep] + b]


def signature_matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = SIGNATURE_BITS // 8
    start = array.offset * size
    return np.frombuffer(array.buffers()[2], np.uint8)[start : start + len(array) * size].reshape(-1, size).view(np.uint64)


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Boundaries of the runs of equal keys."""
    change = np.zeros(len(keys[0]), bool)
    if len(change):
        change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.nonzero(change)[0], len(change))


def candidate_pairs(index: DataFrame, t: float) -> DataFrame:
    """(a, b) distinct set ids, a < b, that survive the lists' filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key, cell_a, cell_b, mine = (part.column(c).to_numpy() for c in ("key", "cell_a", "cell_b", "mine"))
            ids, n, pos = (part.column(c).to_numpy() for c in ("set_id", "n", "pos"))
            sig = signature_matrix(part.column("sig"))
            edge = runs([key, cell_a, cell_b])
            long = np.nonzero(np.diff(edge) > 1)[0]
            found_a, found_b = [], []
            for r in long:
                s = slice(edge[r], edge[r + 1])
                across = cell_a[edge[r]] != cell_b[edge[r]]
                for i, j in compare_list(n[s], pos[s], sig[s], t):
                    if across:
                        keep = mine[s][i] != mine[s][j]
                        i, j = i[keep], j[keep]
                    found_a.append(ids[s][i])
                    found_b.append(ids[s][j])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                pair = pair[pair[:, 0] != pair[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        yield from grouped(batches, ["key", "cell_a", "cell_b"], work)

    if "mine" not in index.columns:
        index = index.withColumn("mine", F.lit(0))
    columns = ["key", "cell_a", "cell_b", "mine", "set_id", "n", "pos", "sig"]
    placed = index.select(*columns).repartition("key", "cell_a", "cell_b").sortWithinPartitions("key", "cell_a", "cell_b")
    return placed.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """Pairs whose sets really reach ``t``: (a, b, similarity)."""
    left = reps.select(F.col("set_id").alias("a"), F.col("tokens").alias("tokens_a"))
    right = reps.select(F.col("set_id").alias("b"), F.col("tokens").alias("tokens_b"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    either = F.size("tokens_a") + F.size("tokens_b") - F.col("both")
    return joined.select("a", "b", (F.col("both") / either).alias("similarity")).where(F.col("similarity") >= F.lit(t) - F.lit(1e-12))


def similar_sets(sets: DataFrame, t: float, list_limit: int = LIST_LIMIT) -> DataFrame:
    """All pairs of different sets with similarity of at least ``t``: (a, b, similarity), a < b as set ids."""
    reps, counts = sequences(sets)
    index = salted(*postings(reps, counts, t, list_limit), list_limit)
    return verified(candidate_pairs(index, t), reps, t)


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None)
