"""Problem 7: mixing sources to target weights.

Method: Poisson replication.  Every document has a number in [0, 1) from a hash of its id and the mix; inverting a
Poisson distribution at that number gives its copies, cut at the source's cap.  The mean is the source's repetition
rate, target tokens over tokens.  Because the hash numbers are fixed, the tokens a mean yields are known from a bounded
histogram of the numbers, and the mean is solved for the target on that histogram; the cap is thus allowed for.  The
copies are exploded and put into one global random order by a hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import cut, name_free
from quillframe.llm.tokens import VOCABULARY, hash_unit, sized

#: Bins of the hash numbers per source; bounds both what the driver holds and the error of a share.
BINS = 4_096
#: Targets a table may hold: the driver keeps one histogram of ``BINS`` numbers for each. More are an error.
MOST_TARGETS = 10_000


def poisson(mean: float, most: int) -> tuple[int, np.ndarray]:
    """(least, edges): a number u in [0, 1) has ``least`` copies and one more for every edge up to it, ``most`` in all.

    Only the numbers within 12 deviations of the mean have edges: what lies outside has less than 1e-20 of the mass, far
    below the width of a bin, so a mean of any size needs few.
    """
    if not math.isfinite(mean):
        return most, np.zeros(0)
    if mean <= 0:
        return 0, np.ones(min(1, most))
    wide = 12 * math.sqrt(mean) + 40
    least = min(most, max(0, math.floor(mean - wide)))
    k = np.arange(least, min(most, math.ceil(mean + wide)), dtype=np.float64)
    steps = np.log(mean) - np.log(np.maximum(k[1:], 1.0))
    first = -mean + least * math.log(mean) - math.lgamma(least + 1)
    return least, np.cumsum(np.exp(np.concatenate([[first], first + np.cumsum(steps)])))[: len(k)]


def _copies(mean: float, most: int, u: np.ndarray) -> np.ndarray:
    """Inverse of the Poisson distribution at ``u``, cut at ``most``."""
    least, edges = poisson(mean, most)
    return least + np.searchsorted(edges, u, side="right")


def solve_mean(tokens: np.ndarray, target: float, most: int) -> float:
    """The mean whose copies of the histogram ``tokens`` come nearest to ``target`` tokens."""
    u = (np.arange(len(tokens)) + 0.5) / len(tokens)
    low, high = 0.0, 4.0 * most + 50.0
    # Only a cap on every document yields this much; no mean does.
    if target >= tokens.sum() * most - 0.5:
        return math.inf
    for _ in range(80):
        mid = (low + high) / 2
        if (_copies(mid, most, u) * tokens).sum() < target:
            low = mid
        else:
            high = mid
    near = [(abs((_copies(m, most, u) * tokens).sum() - target), m) for m in (low, high)]
    return min(near)[1]


def targets(mix_targets: DataFrame) -> list[tuple[str, str, float, int]]:
    """(mix_id, source, weight, cap) that ask for something; the table of targets is a fixed list, not data that grows."""
    rows = name_free(mix_targets, "mix_id", "source", "target_weight", "max_repeats").where("mix_id IS NOT NULL AND source IS NOT NULL AND target_weight > 0 AND NOT isnan(target_weight)")
    merged = rows.groupBy("mix_id", "source").agg(F.max("target_weight").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("m"))
    found = [(r.mix_id, r.source, float(r.w), max(0, int(r.m))) for r in merged.orderBy("mix_id", "source").limit(MOST_TARGETS + 1).collect()]
    if len(found) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets; split the table by mix")
    return found


def planned(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): documents with tokens, and (mix_id, source, target_share, cap, mean, target_tokens).

    The total of a mix is the largest for which every source with documents can reach its share under its cap. Sources
    without documents have a target share and no plan; the others keep their proportions.
    """
    spark = documents.sparkSession
    wanted = targets(mix_targets)
    sizes = cut(sized(documents, vocabulary).where("source IS NOT NULL AND tokens > 0"))
    mixes = sorted({m for m, *_ in wanted})
    plan_schema = "mix_id string, source string, target_share double, cap int, mean double, target_tokens double"
    if not wanted:
        return sizes, spark.createDataFrame([], plan_schema)
    # A document meets only the mixes that ask for its source; the targets are few enough to broadcast.
    pairs = spark.createDataFrame([(s, m) for m, s, *_ in wanted], "source string, mix_id string")
    numbered = sizes.join(F.broadcast(pairs), "source").select("source", "tokens", "doc_id", "mix_id")
    bins = numbered.groupBy("mix_id", "source", F.floor(hash_unit("mix_id", "doc_id") * BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("n"))
    histogram: dict[tuple[str, str], np.ndarray] = {}
    for mix_id, source, held in bins.groupBy("mix_id", "source").agg(F.collect_list(F.struct("bin", "n")).alias("h")).toLocalIterator():
        own = histogram.setdefault((mix_id, source), np.zeros(BINS))
        for b, n in held:
            own[b] = n
    rows = []
    for mix in mixes:
        own = [(s, w, cap) for m, s, w, cap in wanted if m == mix]
        whole = sum(w for _, w, _ in own)
        there = [(s, w, cap, histogram[mix, s]) for s, w, cap in own if (mix, s) in histogram and cap > 0]
        present = sum(w for _, w, *_ in there)
        total = min((cap * h.sum() * present / w for _, w, cap, h in there), default=0.0)
        means = {s: (float(solve_mean(h, total * w / present, cap)), float(total * w / present)) for s, w, cap, h in there}
        rows += [(mix, s, w / whole, cap, *means.get(s, (0.0, 0.0))) for s, w, cap in own]
    return sizes, spark.createDataFrame(rows, plan_schema)


def mixed(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(mix_id, position_key, source, doc_id, copy, tokens): the mix, in global random order by ``position_key``.

    Documents without source or tokens belong to no mix; a row without a positive weight asks for nothing; a missing cap
    is 1; repeated document rows count once; extra columns are ignored; empty tables give an empty mix.
    """
    return replicated(*planned(documents, mix_targets, vocabulary))


def replicated(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The copies of every document under the plan, in global random order."""
    # A plan has one row per target; the edges of its distribution travel as an array of some 24 deviations of its mean.
    rows = []
    for r in plan.where("target_tokens > 0").collect():
        least, edges = poisson(r.mean, r.cap)
        rows.append((r.mix_id, r.source, least, edges.tolist()))
    edges = sizes.sparkSession.createDataFrame(rows, "mix_id string, source string, least int, edges array<double>")
    # Small by its plan, and only then broadcast.
    joined = sizes.join(F.broadcast(edges) if sum(len(r[3]) for r in rows) < 1_000_000 else edges, "source")
    # The middle of the number's bin is what the mean was solved for.
    u = (F.floor(hash_unit("mix_id", "doc_id") * BINS) + 0.5) / BINS
    n = F.col("least") + F.size(F.filter("edges", lambda e: e <= u))
    copies = joined.withColumn("n", n).where("n > 0").select("mix_id", "source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.select("mix_id", F.xxhash64("doc_id", "copy", "mix_id").alias("position_key"), "source", "doc_id", "copy", "tokens")
    return keyed.repartitionByRange("mix_id", "position_key").sortWithinPartitions("mix_id", "position_key", "doc_id", "copy")


def shares(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, n_documents, most_copies) of every target with a weight."""
    sizes, plan = planned(documents, mix_targets, vocabulary)
    out = replicated(sizes, plan)
    per = out.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("n_documents"), F.max("copy").alias("most_copies"))
    total = per.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
    joined = plan.select("mix_id", "source", "target_share").join(per, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    return joined.select(
        "mix_id", "source", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
