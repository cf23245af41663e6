"""Scores of predicted blocks against a reference: agreement, fidelity, error rates and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions.arithmetic import same_answer
from quillframe.functions.quantity import common_items, prf


def ordered_ids(blocks: DataFrame, key: list[str], order: str, name: str) -> DataFrame:
    """Block ids of every document as an ordered array."""
    pairs = F.array_sort(F.collect_list(F.struct(order, "block_id")))
    return blocks.groupBy(*key).agg(F.transform(pairs, lambda p: F.lower(p["block_id"])).alias(name))


def agreement(reference: Column, seen: Column) -> dict[str, Column]:
    """Set agreement of block ids; empty against empty is full agreement."""
    a, b = F.array_distinct(reference), F.array_distinct(seen)
    hits = F.size(F.array_intersect(a, b))
    precision, recall, f = prf(hits, F.size(b), F.size(a))
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return {
        "precision": precision, "recall": recall, "f1": f, "exact": same, "ordered_exact": reference == seen,
        "reordered": same & (reference != seen),
        "missing": F.filter(reference, lambda x: ~F.array_contains(b, x)),
        "extra": F.filter(seen, lambda x: ~F.array_contains(a, x)),
    }


def fidelity(reference: Column, seen: Column) -> dict[str, Column]:
    """Multiset agreement of block ids; empty sides score zero."""
    hits = common_items(reference, seen)
    precision, recall = T.ratio(hits, F.size(seen), 0.0), T.ratio(hits, F.size(reference), 0.0)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    surplus = lambda xs, ys: F.array_sort(F.flatten(F.transform(F.array_distinct(xs), lambda x: F.array_repeat(x, F.greatest(count(xs, x) - count(ys, x), F.lit(0))))))
    repeated = F.array_sort(F.filter(F.array_distinct(seen), lambda x: count(seen, x) > 1))
    common = lambda xs, ys: F.filter(xs, lambda x: F.array_contains(ys, x))
    same = F.array_sort(F.array_distinct(reference)) == F.array_sort(F.array_distinct(seen))
    return {
        "precision": precision, "recall": recall, "f1": T.f1(precision, recall), "set_exact": same & (F.size(repeated) == 0),
        "ordered_exact": reference == seen, "missing": surplus(reference, seen), "extra": surplus(seen, reference),
        "repeated": repeated, "reordered": common(reference, seen) != common(seen, reference),
    }


def compared(reference: DataFrame, seen: DataFrame) -> DataFrame:
    """Full outer join of two runs on (id, block_id); a missing side is empty."""
    a = reference.select("id", "block_id", F.col("text").alias("reference"))
    b = seen.select("id", "block_id", F.col("text").alias("seen"))
    return a.join(b, ["id", "block_id"], "full_outer")


def first_per_block(blocks: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first occurrence of every block id of a document."""
    first = blocks.groupBy(*key, "block_id").agg(F.min_by("text", order).alias("text"))
    return first


def micro_error(rows: DataFrame, by: list[str], distance: str = "distance", length: str = "length") -> DataFrame:
    """Sum of distances over sum of lengths per group; 0 of 0 is 0 and anything of 0 is 1."""
    total = rows.groupBy(*by).agg(F.sum(distance).cast("long").alias("distance"), F.sum(length).cast("long").alias("length"))
    rate = F.when(F.col("length") == 0, F.when(F.col("distance") == 0, 0.0).otherwise(1.0)).otherwise(F.col("distance") / F.col("length"))
    return total.withColumn("error_rate", rate)


def block_aligned(reference: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, distance, length): per document, the distances of its reference blocks plus everything unmatched as insertion.

    ``reference`` (id, block_id, text) and ``seen`` (id, ord, block_id, text) with null ids for text outside any block.
    """
    ranked = seen.groupBy("id", "block_id").agg(F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"))
    known = reference.join(ranked.select("id", "block_id", F.col("text").alias("seen"), "ord"), ["id", "block_id"], "left")
    scored = known.select("id", T.char_distance(F.col("text"), F.coalesce("seen", F.lit(""))).alias("d"), F.length("text").alias("n"))
    used = reference.select("id", "block_id").join(ranked.select("id", "block_id", "ord"), ["id", "block_id"]).select("id", "ord")
    extra = seen.join(used, ["id", "ord"], "left_anti").join(reference.select("id").distinct(), "id", "left_semi")
    every = scored.unionAll(extra.select("id", F.length("text").alias("d"), F.lit(0).alias("n")))
    return every.groupBy("id").agg(F.sum("d").cast("long").alias("distance"), F.sum("n").cast("long").alias("length"))


def latency(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Mean, median, nearest-rank 95th percentile, maximum and documents a minute of the numeric samples."""
    s = F.col(seconds)
    return rows.groupBy(*by).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.expr(f"median({seconds})").alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {seconds})").alias("p95"), F.max(s).alias("most"), (F.lit(60.0) / F.avg(s)).alias("per_minute"),
    )


def instance_scores(documents: DataFrame) -> DataFrame:
    """The composite score of a document: ``documents`` (id, a, b, xs, ys) hold reference and seen text and block ids.

    Errors are over the reference's length; nothing against nothing is no error, anything against nothing is all error.
    """
    a, b = F.col("a"), F.col("b")
    n, m = F.length(a).cast("long"), F.length(b).cast("long")
    d = T.char_distance(a, b).cast("long")
    cer = F.when(F.col("reference_chars") == 0, F.when(F.col("seen_chars") == 0, 0.0).otherwise(1.0)).otherwise(F.col("distance") / F.col("reference_chars"))
    base = documents.select("id", (a == b).alias("exact"), n.alias("reference_chars"), m.alias("seen_chars"), d.alias("distance"), "xs", "ys")
    ids = agreement(F.col("xs"), F.col("ys"))
    return base.select(
        "id", "exact", "reference_chars", "seen_chars", "distance", cer.alias("cer"), F.greatest(F.lit(0.0), 1 - cer).alias("accuracy"),
        T.similarity(F.col("distance"), F.col("reference_chars"), F.col("seen_chars")).alias("similarity"), ids["f1"].alias("block_f1"), ids["ordered_exact"].alias("ordered_exact"),
    )


def scorecard(scores: DataFrame) -> DataFrame:
    """Macro and micro rates over all documents of :func:`instance_scores`."""
    micro = F.sum("distance") / F.sum("reference_chars")
    return scores.agg(
        F.count("*").alias("instances"), F.count(F.when(F.col("exact"), 1)).alias("exact_count"), F.avg("cer").alias("macro_cer"), micro.alias("micro_cer"),
        (100.0 * F.greatest(F.lit(0.0), 1 - micro)).alias("text_score"), F.avg("similarity").alias("macro_similarity"), F.avg("block_f1").alias("mean_block_f1"),
        F.count(F.when(F.col("ordered_exact"), 1)).alias("ordered_exact_count"), (F.count(F.when(F.col("ordered_exact"), 1)) / F.count("*")).alias("ordered_exact_rate"),
    )


def portal(rows: DataFrame) -> DataFrame:
    """Scores of submitted rows (told, shown) against labels (answer, evidence), evidence as sorted sets; nothing against
    nothing agrees."""
    shown, label = F.col("shown"), F.col("evidence")
    hits, size = F.size(F.array_intersect(shown, label)), F.size(shown) + F.size(label)
    return rows.withColumn("answer_score", same_answer(F.col("told"), F.col("answer")).cast("double")).withColumn("evidence_exact", (shown == label).cast("double")).withColumn("evidence_f1", F.when(size == 0, 1.0).otherwise(2.0 * hits / size))
