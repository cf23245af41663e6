"""Problem 2: the same or nearly the same records across splits.

Method: a partitioned suffix array (see :mod:`quillframe.llm.suffixes`).  Cross-split neighbours with a long common prefix
reveal shared spans.

* ``cross_split_pairs``: the array holds texts in one consistent order of their distinct words, in which reordering and
  repetition have disappeared.  Two sets of similarity ``t`` then share a span of ``guaranteed`` words (three, for 0.75 and
  12 words or more) that starts no later than ``reach``, so neighbours with that common prefix include every similar
  pair.  Only the left end of a shared span proposes its pair; sizes, positions and 128-bit signatures thin the proposals
  out, and an exact check on the words follows.  A span that is far too frequent is dealt by the rarest words of its texts,
  of which similar texts share one, and what is still too long by cells.  Paths that name one file are joined by equality.
* ``shared_spans``: the array holds the texts as written; the spans an evaluation record shares with any train record
  are merged into its coverage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import setjoin, suffixes
from quillframe.llm.common import SKETCH_BUCKETS, cut, grouped, histogram, name_free, salted_join, words
from quillframe.llm.suffixes import Texts

SIMILARITY = 0.75
LEAST_WORDS = 12
#: Words of the shortest span that counts as shared.
SPAN = 5
#: Words of a suffix that the array of pairs compares at most.
DEPTH = 3
#: Cells into which the evaluation side of a frequent span is dealt.
CELLS = 64


def canonical_file(path: Column) -> Column:
    """The file a path names: no folders, letter case, separators, repeated suffixes or copy marks; null for no file."""
    clean = F.regexp_replace(F.try_url_decode(F.regexp_replace(path, r"%(?![0-9A-Fa-f]{2})|\+", "_")), r"\\", "/")
    clean = F.coalesce(clean, F.regexp_replace(path, r"\\", "/"))
    base = F.lower(F.trim(F.element_at(F.split(F.regexp_replace(F.trim(clean), "/+$", ""), "/"), -1)))
    base = F.regexp_replace(base, r"(\s*\.pdf)+$", "")
    copy = r"(?:[\s_-]*\(\d+\)|[\s_-]+copy(?:[\s_-]*\(?\d\)?)?|\.pdf)+$"
    base = F.regexp_replace(base, copy, "")
    base = F.regexp_replace(base, r"^copy[\s_-]+of[\s_-]+", "")
    base = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(base == "", None).otherwise(base)


def side(split: Column, path: Column) -> Column:
    """``train`` or ``eval`` by the split, or where it is null by the first folder of the path; null otherwise."""
    folder = F.element_at(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", ".", "..")), 1)
    name = F.lower(F.trim(F.coalesce(split, folder)))
    return (
        F.when(name.isin("train", "training"), "train")
        .when(name.isin("val", "valid", "validation", "dev", "test", "testing"), "eval")
    )


def split_name(split: Column, path: Column) -> Column:
    """One spelling per split: train, validation or test."""
    folder = F.element_at(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", ".", "..")), 1)
    name = F.lower(F.trim(F.coalesce(split, folder)))
    return F.when(name.isin("val", "valid", "dev"), "validation").when(name == "training", "train").when(name == "testing", "test").otherwise(name)


def _sided(tasks: DataFrame) -> DataFrame:
    rows = name_free(tasks, "instance_id", "user_query", "document_pdf", "split").where("instance_id IS NOT NULL")
    rows = rows.withColumn("side", side(F.col("split"), F.col("document_pdf"))).where("side IS NOT NULL")
    return rows.select("instance_id", "user_query", "document_pdf", "side")


def guaranteed(similarity: float, least: int) -> int:
    """Words of the longest span that every two similar texts share in their consistent order, at most ``DEPTH``.

    Two sets with ``o`` words in both and ``d`` in one only are, in one order of all words, cut into at most ``d + 1``
    runs of common words, so one run has ``ceil(o / (d + 1))``; similarity asks for ``o >= d * t / (1 - t)``.
    """
    if similarity >= 1:
        return DEPTH
    rate = similarity / (1 - similarity)
    shortest = DEPTH
    for d in range(1, 2 * DEPTH + 2 * least + 2):
        both = max(1, math.ceil(rate * d - 1e-9), math.ceil((2 * least - d) / 2))
        shortest = min(shortest, math.ceil(both / (d + 1)))
    return max(1, shortest)


def reach(size: np.ndarray, depth: int, similarity: float) -> np.ndarray:
    """The last position at which the first shared span of ``depth`` words can start in a text of ``size`` words.

    Before it, each of the ``d`` words of one text only follows at most ``depth - 1`` common ones.
    """
    last = np.maximum(depth * (1 - similarity), (depth - 1) * (1 - similarity) / similarity) * size
    return np.minimum(np.floor(last + 1e-9), size - depth)


class Array:
    """The suffix array of the canonical texts and the pairs its neighbours propose."""

    def __init__(self, reps: DataFrame, similarity: float, least: int, list_limit: int) -> None:
        self.t, self.limit = similarity, list_limit
        self.depth = depth = guaranteed(similarity, least)

        def starts(texts: Texts) -> tuple[np.ndarray, list[np.ndarray]]:
            at = np.nonzero(texts.pos <= reach(texts.size, depth, similarity))[0]
            return at, suffixes.heads(texts, at, depth)

        def spans(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            texts = suffixes.concatenated(batch.column("tokens"))
            at, head = starts(texts)
            span = suffixes.mixed(head)
            for side, name in ((suffixes.TRAIN, "train"), (suffixes.HELD, "held")):
                yield side, span[batch.column(name).to_numpy()[texts.row[at]] == 1]

        marks = suffixes.shared(reps.select("tokens", "train", "held"), spans, list_limit)
        hot = bool(marks.hot.any())
        # Only a text under a frequent span needs to know which of its words are rare.
        count = np.asarray(histogram(reps.select(F.explode("tokens").alias("token")), "token"), np.int64) if hot else None
        schema = "h1 long, h3 int, deal long, at long, before int, set_id long, s1 long, s2 long"
        names = [f.split()[0] for f in schema.split(", ")]

        def rare(texts: Texts, rows: np.ndarray) -> dict[int, np.ndarray]:
            """The words of a text of which two similar texts share at least one: its rarest ones."""
            start = np.cumsum(texts.sizes) - texts.sizes
            out = {}
            for r in np.unique(rows):
                words_ = texts.flat[start[r] : start[r] + texts.sizes[r]]
                n = len(words_) - math.ceil(similarity * len(words_) - 1e-9) + 1
                out[int(r)] = words_[np.lexsort((words_, count[np.mod(words_, SKETCH_BUCKETS)]))[:n]]
            return out

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                texts = suffixes.concatenated(batch.column("tokens"))
                at, head = starts(texts)
                span = suffixes.mixed(head)
                keep = marks.both(span)
                at, head, span = at[keep], [h[keep] for h in head], span[keep]
                row = texts.row[at]
                deal = np.zeros(len(at), np.int64)
                if hot and (busy := marks.frequent(span)).any():
                    few = rare(texts, row[busy])
                    copies = np.ones(len(at), np.int64)
                    copies[busy] = [len(few[int(r)]) for r in row[busy]]
                    words_ = [few[int(r)] for r in row[busy]]
                    pick = np.repeat(np.arange(len(at)), copies)
                    deal = np.zeros(len(pick), np.int64)
                    deal[busy[pick]] = np.concatenate(words_) | 1
                    at, row, head = at[pick], row[pick], [h[pick] for h in head]
                pos = texts.pos[at]
                before = (texts.flat >> 32).astype(np.int32)[np.maximum(at - 1, 0)]
                bit = (texts.flat & 127).astype(np.int64)
                odd = np.bincount(texts.row * 128 + bit, minlength=128 * batch.num_rows).reshape(-1, 128) & 1
                sign = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                third = ((head[1] if len(head) > 1 else np.zeros(len(at), np.int64)) >> 32).astype(np.int32)
                ids = batch.column("set_id").to_numpy()
                for side, name in ((suffixes.TRAIN, "train"), (suffixes.HELD, "held")):
                    own = batch.column(name).to_numpy()[row] == 1
                    place = (np.int64(side) << 62) | (texts.sizes[row].astype(np.int64) << 31) | pos
                    cols = [head[0], third, deal, place, before, ids[row], sign[row, 0], sign[row, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in cols], names)

        self.entries = reps.select("set_id", "tokens", "train", "held").mapInArrow(build, schema)
        self.dealt = hot

    def arranged(self) -> DataFrame:
        """The array itself: entries with their cell, partitioned by head and sorted; spans still too long lie in several cells."""
        entries = self.entries
        cell = F.lit(0)
        if self.dealt:
            sizes = histogram(entries.where("deal != 0").select(F.xxhash64("h1", "h3", "deal").alias("k")), "k")
            limit = max(self.limit, 4 * sum(sizes) // len(sizes))
            many = {b: math.ceil(n / limit) for b, n in enumerate(sizes) if n > limit}
            if many:
                # At most one number for each bucket of the sketch.
                small = entries.sparkSession.createDataFrame(sorted(many.items()), "b int, cells int")
                bucket = F.when(F.col("deal") != 0, F.pmod(F.xxhash64("h1", "h3", "deal"), F.lit(SKETCH_BUCKETS)).cast("int"))
                entries = entries.withColumn("b", bucket).join(F.broadcast(small), "b", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
                # A train text lies in one cell, an evaluation text in all of them.
                own = F.array(F.pmod(F.xxhash64("set_id"), F.col("cells")).cast("int"))
                every = F.sequence(F.lit(0), F.col("cells") - 1)
                entries = entries.withColumn("cell", F.explode(F.when(F.shiftrightunsigned("at", 62) == suffixes.TRAIN, own).otherwise(every)))
                cell = F.col("cell")
        entries = entries.select("h1", "h3", "deal", cell.alias("cell"), "at", "before", "set_id", "s1", "s2")
        return entries.repartition("h1", "h3", "deal", "cell").sortWithinPartitions("h1", "h3", "deal", "cell")

    def proposed(self) -> DataFrame:
        """(a, b): an evaluation text and a train text whose suffixes are neighbours and whose sizes and signatures agree."""
        depth, t = self.depth, self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
                h1, h3, deal, cell, at, before, ids, s1, s2 = (part.column(c).to_numpy() for c in part.column_names)
                prefix = suffixes.common_prefix([h1, h3.astype(np.int64) << 32], depth)
                edge = np.nonzero((prefix < depth) | np.append(True, (deal[1:] != deal[:-1]) | (cell[1:] != cell[:-1])))[0]
                edge = np.append(edge, len(h1))
                side = at.view(np.uint64) >> np.uint64(62)
                size, pos = (at >> 31) & 0x7FFFFFFF, at & 0x7FFFFFFF
                s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
                found = []
                for i, j in suffixes.cross_pairs(edge, side):
                    # A span that goes on to the left is met again one word earlier.
                    start = (pos[i] == 0) | (pos[j] == 0) | (before[i] != before[j])
                    i, j = i[start], j[start]
                    differ = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int32) + np.bitwise_count(s2[i] ^ s2[j])
                    total = size[i] + size[j]
                    need = np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)
                    best = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j])
                    near = (differ <= total - 2 * need) & (best >= need) & (ids[i] != ids[j])
                    found.append(np.stack([ids[i[near]], ids[j[near]]], 1))
                if found and sum(map(len, found)):
                    pair = np.unique(np.concatenate(found), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

            yield from grouped(batches, ["h1", "h3", "deal", "cell"], work)

        return self.arranged().mapInArrow(run, "a long, b long").distinct()


def cross_split_pairs(tasks: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS, list_limit: int = setjoin.LIST_LIMIT) -> DataFrame:
    """Pairs (instance_id_a, instance_id_b) of a train task and an evaluation task with the same file or similar queries.

    Rows without id or side are ignored; a null query or path matches nothing; queries of fewer than ``least`` distinct
    words match nothing; repeated rows count once; extra columns are ignored; an empty table gives an empty result.
    """
    tokens = F.array_sort(F.transform(words(F.col("user_query")), lambda w: F.xxhash64(w)))
    # Words are split and names are cleaned once; everything after reads hashes.
    rows = cut(_sided(tasks).select("instance_id", "side", canonical_file(F.col("document_pdf")).alias("file"), tokens.alias("tokens")))
    texts = rows.where(F.size("tokens") >= least).select("instance_id", "side", "tokens", F.xxhash64("tokens").alias("set_id"))
    flags = [F.max((F.col("side") == s).cast("int")).alias(c) for s, c in (("train", "train"), ("eval", "held"))]
    reps = cut(texts.groupBy("set_id").agg(F.first("tokens").alias("tokens"), *flags))
    near = setjoin.verified(Array(reps, similarity, least, list_limit).proposed(), reps, similarity).select("a", "b")
    # Equal texts are one text of the array, with both sides.
    same = reps.where("train = 1 AND held = 1").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))
    files = rows.where("file IS NOT NULL")
    return _instances(cut(near.unionByName(same)), texts.select("instance_id", "side", "set_id").distinct(), files.select("instance_id", "side", "file").distinct())


def _instances(links: DataFrame, texts: DataFrame, files: DataFrame) -> DataFrame:
    """The pairs of instances behind links of texts and behind equal files."""
    held = texts.where("side = 'eval'").select(F.col("instance_id").alias("x"), F.col("set_id").alias("a"))
    train = texts.where("side = 'train'").select(F.col("instance_id").alias("y"), F.col("set_id").alias("b"))
    queries = salted_join(salted_join(links, held, "a"), train, "b").select("x", "y")
    left = files.where("side = 'eval'").select(F.col("instance_id").alias("x"), "file")
    right = files.where("side = 'train'").select(F.col("instance_id").alias("y"), "file")
    out = queries.unionByName(salted_join(left, right, "file").select("x", "y")).where("x != y")
    return out.select(F.least("x", "y").alias("instance_id_a"), F.greatest("x", "y").alias("instance_id_b")).distinct()


def overlap_report(tasks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per evaluation split and source: (split_name, source, n_tasks, n_overlapping, n_pairs)."""
    rows = name_free(tasks, "instance_id", "document_pdf", "split", "source").where("instance_id IS NOT NULL")
    rows = rows.withColumn("side", side(F.col("split"), F.col("document_pdf"))).where("side = 'eval'")
    held = rows.groupBy("instance_id").agg(
        F.min(split_name(F.col("split"), F.col("document_pdf"))).alias("split_name"), F.coalesce(F.min("source"), F.lit("unknown")).alias("source")
    )
    ends = pairs.select(F.col("instance_id_a").alias("instance_id")).unionAll(pairs.select(F.col("instance_id_b").alias("instance_id")))
    per = ends.groupBy("instance_id").agg(F.count("*").alias("n"))
    joined = held.join(per, "instance_id", "left")
    return joined.groupBy("split_name", "source").agg(
        F.count("*").alias("n_tasks"),
        F.count("n").alias("n_overlapping"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_pairs"),
    )


def shared_spans(tasks: DataFrame, span: int = SPAN, list_limit: int = setjoin.LIST_LIMIT) -> DataFrame:
    """Per evaluation task: (instance_id, n_words, n_covered, coverage), words lying in spans shared with train.

    A span is ``span`` or more consecutive words of the query as written: a suffix of an evaluation query whose
    neighbours with a common prefix of ``span`` words include one of a train query. A longer common prefix is met again
    at each of its words, so prefixes are compared to ``span`` words. Null or shorter queries have coverage 0.
    """
    rows = _sided(tasks).select("instance_id", "side", F.coalesce("user_query", F.lit("")).alias("q"))
    token = F.transform(F.regexp_extract_all(F.lower("q"), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.xxhash64(w))
    rows = cut(rows.select("instance_id", "side", token.alias("tokens"))).withColumn("text_id", F.xxhash64("tokens"))
    flags = [F.max((F.col("side") == s).cast("int")).alias(c) for s, c in (("train", "train"), ("eval", "held"))]
    texts = cut(rows.groupBy("text_id").agg(F.first("tokens").alias("tokens"), *flags))

    def starts(batch: pa.RecordBatch) -> tuple[Texts, np.ndarray, list[np.ndarray]]:
        whole = suffixes.concatenated(batch.column("tokens"))
        at = np.nonzero(whole.pos <= whole.size - span)[0]
        return whole, at, suffixes.heads(whole, at, span)

    def spans(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        whole, at, head = starts(batch)
        every = suffixes.mixed(head)
        for side, name in ((suffixes.TRAIN, "train"), (suffixes.HELD, "held")):
            yield side, every[batch.column(name).to_numpy()[whole.row[at]] == 1]

    marks = suffixes.shared(texts.select("tokens", "train", "held"), spans, list_limit)
    width = (span + 1) // 2
    words_ = [f"h{k}" for k in range(width)]
    schema = ", ".join(f"{w} long" for w in words_) + ", cell int, held boolean, text_id long, at int"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, at, head = starts(batch)
            every = suffixes.mixed(head)
            keep = marks.both(every)
            at, head, every = at[keep], [h[keep] for h in head], every[keep]
            row, ids = whole.row[at], batch.column("text_id").to_numpy()
            busy = marks.frequent(every)
            # Of a train span only its presence counts; a frequent one is present in every cell.
            own = np.nonzero(batch.column("train").to_numpy()[row] == 1)[0]
            own = own[np.unique(every[own], return_index=True)[1]]
            pick = np.repeat(own, np.where(busy[own], CELLS, 1))
            first = np.cumsum(np.where(busy[own], CELLS, 1)) - np.where(busy[own], CELLS, 1)
            cells = np.arange(len(pick)) - np.repeat(first, np.where(busy[own], CELLS, 1))
            zero = np.zeros(len(pick), np.int64)
            for at_, cell, flag, text, place in (
                (pick, cells, False, zero, zero),
                (h := np.nonzero(batch.column("held").to_numpy()[row] == 1)[0], np.where(busy[h], np.mod(ids[row[h]], CELLS), 0), True, ids[row[h]], whole.pos[at[h]]),
            ):
                cols = [*[pa.array(w[at_]) for w in head], pa.array(cell.astype(np.int32)), pa.array(np.full(len(at_), flag)), pa.array(text), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [*words_, "cell", "held", "text_id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
            cell = part.column("cell").to_numpy()
            prefix = suffixes.common_prefix([part.column(w).to_numpy() for w in words_], span)
            stretch = np.cumsum((prefix < span) | np.append(True, cell[1:] != cell[:-1])) - 1
            held = part.column("held").to_numpy(zero_copy_only=False)
            shared = np.bincount(stretch[~held], minlength=stretch[-1] + 1 if len(stretch) else 0) > 0
            hit = pa.array(held & shared[stretch])
            yield pa.RecordBatch.from_arrays([part.column(c).filter(hit).combine_chunks() for c in ("text_id", "at")], ["text_id", "at"])

        yield from grouped(batches, [*words_, "cell"], work)

    keys = [*words_, "cell"]
    array = texts.select("text_id", "tokens", "train", "held").mapInArrow(build, schema).repartition(*keys).sortWithinPartitions(*keys)
    shared_at = array.mapInArrow(run, "text_id long, at int")
    covered = shared_at.groupBy("text_id").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(span), x + span - acc["end"])).alias("n"), (x + span).alias("end"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("end"))
    covered = covered.select("text_id", F.aggregate("ats", zero, step)["n"].alias("n_covered"))
    held = rows.where("side = 'eval'").select("instance_id", "text_id", F.size("tokens").alias("n_words")).distinct()
    out = held.join(covered, "text_id", "left")
    n = F.coalesce("n_covered", F.lit(0)).cast("long")
    return out.select("instance_id", F.col("n_words").cast("long").alias("n_words"), n.alias("n_covered"), F.round(F.when(F.col("n_words") > 0, n / F.col("n_words")).otherwise(0.0), 6).alias("coverage"))
