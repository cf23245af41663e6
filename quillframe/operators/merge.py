"""Merging shards of results with their manifest and run reports, and expanding and overlaying review shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.arithmetic import same_answer
from quillframe.operators.review import ALIGNMENTS, SEVERITIES
from quillframe.operators.rules import Rule, violations

# Short names of issue tags and the tags they stand for.
TAG_ALIASES = {
    "comparison_sign_direction": "comparison_polarity_or_sign",
    "role_attribution": "role_or_subject_attribution",
    "condition_insertion_deletion": "condition_insertion_or_deletion",
    "quantifier_last_vs_remaining": "quantifier_scope_last_remaining",
    "ordinal_mismatch": "ordinal_or_count_mismatch",
    "rate_unit_corruption": "rate_unit_relation_corruption",
    "target_subquestion_drift": "target_or_subquestion_drift",
    "distractor": "distractor_operand_interference",
    "label_carryover_suspected": "label_template_carryover_suspected",
    "abs_sign_normalization": "answer_normalization_abs_sign",
    "implicit_assumption": "implicit_default_assumption",
    "ocr_uncertainty": "extraction_or_ocr_uncertain",
}
COHORT = ("schema_version", "machine", "revision", "manifest_sha")


def merge_violations(manifest: DataFrame, results: DataFrame, runs: DataFrame, n_shards: int) -> DataFrame:
    """(subject, rule): everything that keeps shard results from being published as one table.

    ``manifest`` (instance_id, shard, user_query, pdf_sha), ``results`` (shard, instance_id, user_query, pdf_sha, status,
    configuration), ``runs`` (shard, record_count, failed_count, dirty and the cohort columns).  A record is bound to its
    manifest row; a run report to the records of its shard, and to the report of shard 0.
    """
    copies = results.groupBy("instance_id").agg(F.count("*").alias("copies"))
    wanted = manifest.select("instance_id", F.col("shard").alias("assigned"), F.col("user_query").alias("asked"), F.col("pdf_sha").alias("sha"))
    # The configuration of the first record, in shard and id order, is that of all; one row.
    first = results.agg(F.min_by("configuration", F.struct("shard", "instance_id")).alias("first_configuration"))
    bound = results.join(wanted.withColumn("known", F.lit(True)), "instance_id", "left").join(copies, "instance_id").join(F.broadcast(first))
    known = F.coalesce("known", F.lit(False))
    records = violations(
        bound.withColumnRenamed("instance_id", "subject"), ["subject"],
        [
            Rule("unexpected_id", ~known), Rule("wrong_shard", known & (F.col("shard") != F.col("assigned"))), Rule("duplicate_id", F.col("copies") > 1),
            Rule("query_differs", known & ~F.col("user_query").eqNullSafe(F.col("asked"))), Rule("pdf_differs", known & ~F.col("pdf_sha").eqNullSafe(F.col("sha"))),
            Rule("failed_record", F.coalesce(F.col("status") != "ok", F.lit(True))), Rule("configuration_differs", ~F.col("configuration").eqNullSafe(F.col("first_configuration"))),
        ],
    )
    missing = manifest.join(results.select("instance_id"), "instance_id", "left_anti").select(F.col("instance_id").alias("subject"), F.lit("missing_id").alias("rule"))
    held = results.groupBy("shard").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"))
    leader = runs.where("shard = 0").select(F.struct(*COHORT).alias("leader")).limit(1)
    reports = runs.withColumn("reported", F.lit(True)).join(held, "shard", "full_outer").join(F.broadcast(leader), how="left")
    n, failed = F.coalesce("n", F.lit(0)), F.coalesce("n_failed", F.lit(0))
    told = F.coalesce("reported", F.lit(False))
    shards = violations(
        reports.withColumn("subject", F.format_string("shard-%02d", "shard")), ["subject"],
        [
            Rule("shard_out_of_range", ~F.col("shard").between(0, n_shards - 1)), Rule("run_report_missing", ~told), Rule("record_count_differs", told & (F.col("record_count") != n)),
            Rule("failed_count_differs", told & (F.col("failed_count") != failed)), Rule("failed_exceeds_records", F.col("failed_count") > F.col("record_count")),
            Rule("dirty_repository", F.col("dirty")), Rule("cohort_differs", told & ~F.struct(*COHORT).eqNullSafe(F.col("leader"))),
        ],
    )
    spark = manifest.sparkSession
    every = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    absent = every.join(results.select("shard").distinct(), "shard", "left_anti").select(F.format_string("shard-%02d", "shard").alias("subject"), F.lit("shard_missing").alias("rule"))
    return records.unionByName(missing).unionByName(shards).unionByName(absent).distinct()


def expanded_reviews(ranges: DataFrame, overrides: DataFrame) -> DataFrame:
    """One decision per id of a review shard: the override of the id, or the shard's default.

    ``ranges`` (shard, first, last, severity, tags), ``overrides`` (shard, instance_id, severity, tags).  Aliases of tags are
    resolved.
    """
    ids = ranges.select("shard", "severity", "tags", F.explode(F.sequence("first", "last")).alias("n"))
    ids = ids.select("shard", F.format_string("task_%06d", "n").alias("instance_id"), F.col("severity").alias("s"), F.col("tags").alias("t"))
    named = overrides.dropDuplicates(["shard", "instance_id"])
    joined = ids.join(named, ["shard", "instance_id"], "left")
    return joined.select("shard", "instance_id", F.coalesce("severity", "s").alias("severity"), resolved(F.coalesce("tags", "t")).alias("tags"))


def review_shard_violations(ranges: DataFrame, overrides: DataFrame) -> DataFrame:
    """(subject, rule): overrides outside the range of their shard or named twice, defaults that are not clean, overrides
    that are, a wrong number of overrides, and ids that two shards decide."""
    where = overrides.join(ranges.select("shard", "first", "last"), "shard", "left")
    times = overrides.groupBy("shard", "instance_id").agg(F.count("*").alias("times"))
    rows = where.join(times, ["shard", "instance_id"]).withColumn("tags", resolved(F.col("tags")))
    own = violations(
        rows.withColumnRenamed("instance_id", "subject").withColumn("at", F.regexp_extract("subject", r"^task_(\d{6})$", 1).try_cast("int")), ["subject"],
        [
            Rule("override_outside_range", F.coalesce(~F.col("at").between(F.col("first"), F.col("last")), F.lit(True))), Rule("override_twice", F.col("times") > 1),
            Rule("override_not_graded", F.coalesce(~F.col("severity").isin(*SEVERITIES[1:]), F.lit(True)) | (F.size("tags") == 0) | F.array_contains("tags", "clean")),
        ],
    )
    held = overrides.groupBy("shard").agg(F.countDistinct("instance_id").alias("n_overrides"))
    defaults = violations(
        ranges.join(held, "shard", "left").withColumnRenamed("shard", "subject"), ["subject"],
        [
            Rule("default_not_clean", (F.col("severity") != "S0") | (F.col("tags") != F.array(F.lit("clean")))),
            Rule("override_count_differs", F.col("expected_overrides") != F.coalesce("n_overrides", F.lit(0))),
        ],
    )
    # Two ranges are compared by their ends, not by their ids; shards are few.
    a, b = ranges.select(F.col("shard").alias("x"), F.col("first").alias("fx"), F.col("last").alias("lx")), ranges.select(F.col("shard").alias("y"), F.col("first").alias("fy"), F.col("last").alias("ly"))
    both = a.join(b, (F.col("x") < F.col("y")) & (F.col("fx") <= F.col("ly")) & (F.col("fy") <= F.col("lx")))
    crossing = both.select(F.col("y").alias("subject"), F.lit("shards_overlap").alias("rule"))
    return own.unionByName(defaults).unionByName(crossing).distinct()


def resolved(tags: Column) -> Column:
    """Tags with their aliases replaced, sorted and distinct."""
    alias = F.create_map(*[F.lit(x) for pair in TAG_ALIASES.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.coalesce(alias[t], t))))


def alignment(computed: Column, answer: Column) -> Column:
    """How a label's answer relates to a computed one; without a computed answer nothing can be said."""
    equal = same_answer(computed, answer)
    return F.when(F.coalesce(computed, F.lit("")) == "", "label_unverifiable").when(equal & (computed == answer), "aligned").when(equal, "normalized_equivalent").otherwise("semantic_conflict")


def overlaid(screened: DataFrame, reviews: DataFrame) -> DataFrame:
    """(instance_id, severity, tags, alignment, risk, disagrees): what the screen found, with a review's decision over it.

    ``screened`` (instance_id, severity, tags, alignment, answer), ``reviews`` (instance_id, severity, tags, alignment,
    value).  A review's severity wins; its tags replace the screen's when it clears the record, else they are added; its
    alignment wins if it is a known one; ``disagrees`` marks a claimed alignment that its own value contradicts.
    """
    r = reviews.select("instance_id", F.lit(True).alias("reviewed"), *[F.col(c).alias(f"r_{c}") for c in ("severity", "tags", "alignment", "value")])
    j = screened.join(r, "instance_id", "left")
    reviewed = F.coalesce("reviewed", F.lit(False))
    grade = F.coalesce("r_severity", "severity")
    own = resolved(F.coalesce("r_tags", "tags"))
    tags = F.when(~reviewed, F.col("tags")).when(grade == "S0", own).otherwise(F.array_union("tags", own))
    without = F.array_remove(tags, "clean")
    tags = F.when((grade != "S0") | (F.size(tags) > 1), without).when(F.size(tags) == 0, F.array(F.lit("clean"))).otherwise(tags)
    derived = alignment(F.col("r_value"), F.col("answer"))
    claims = F.col("r_alignment").isin(*[a for a in ALIGNMENTS if a != "label_unverifiable"])
    return j.select(
        "instance_id", grade.alias("severity"), F.array_sort(tags).alias("tags"),
        F.when(F.col("r_alignment").isin(*ALIGNMENTS), F.col("r_alignment")).otherwise(F.col("alignment")).alias("alignment"), risk(grade).alias("risk"),
        F.coalesce(F.col("r_value").isNotNull() & claims & (F.col("r_alignment") != derived), F.lit(False)).alias("disagrees"),
    )


def risk(severity: Column) -> Column:
    return F.when(severity == "S0", "none").when(severity == "S1", "low").when(severity == "S2", "medium").when(severity.isin("S3", "S4"), "high")
