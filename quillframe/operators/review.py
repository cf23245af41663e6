"""Contracts of reviews, questions, references, audits and runs; and recovering a query from blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.rules import Rule, is_block_id, is_safe_path

# The domains of reviews and audits.
CONFIDENCE = ("high", "medium", "low")
SEVERITIES = ("S0", "S1", "S2", "S3", "S4")
ALIGNMENTS = ("aligned", "normalized_equivalent", "semantic_conflict", "label_unverifiable")


def review_rules() -> list[Rule]:
    """A review pass: a run id of 8 to 128 characters, evidence of distinct block ids, a level or a share as confidence."""
    level, evidence = F.col("confidence"), F.col("evidence")
    share = level.try_cast("double")
    return [
        Rule("bad_run_id", F.coalesce(~F.length("run_id").between(8, 128), F.lit(True))),
        Rule("bad_answer", F.col("unique_answer") & F.coalesce(~F.col("answer").rlike(r"^\S+$"), F.lit(True))),
        Rule("answer_without_uniqueness", ~F.col("unique_answer") & F.col("answer").isNotNull()),
        Rule("bad_evidence", F.coalesce(F.exists(evidence, lambda b: F.coalesce(~is_block_id(b), F.lit(True))) | (F.size(F.array_distinct(evidence)) < F.size(evidence)), F.lit(True))),
        Rule("bad_confidence", F.coalesce(~level.isin(*CONFIDENCE) & F.coalesce(~share.between(0, 1), F.lit(True)), F.lit(True))),
    ]


# Fields that give a label away.
LABEL_FIELDS = ("answer", "candidate_answers", "evidence", "labels", "portal_score", "portal_scores")


def gives_label_away(fields: Column) -> Column:
    """Whether a record has a field that holds or hints at its label."""
    return F.exists(fields, lambda f: F.lower(f).isin(*LABEL_FIELDS))


def question_rules(forbidden: Column) -> list[Rule]:
    """A blind question: an id, text, a safe path, pages with text, and no label field."""
    return [
        Rule("no_question", F.coalesce(F.trim("question_text") == "", F.lit(True))),
        Rule("unsafe_path", ~is_safe_path(F.col("pdf_path"))),
        Rule("no_pages", F.coalesce(F.size("pages") < 1, F.lit(True))),
        Rule("label_field", forbidden),
    ]


def reference_rules() -> list[Rule]:
    """A reference document: block ids b01, b02, … in order without gaps, each with text."""
    ids = F.col("ids")
    wanted = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), lambda i: F.format_string("b%02d", i))
    return [Rule("ids_not_consecutive", ids != wanted), Rule("empty_text", F.col("n_empty") > 0), Rule("not_ok", F.coalesce(F.col("status") != "ok", F.lit(True)))]


def audit_rules() -> list[Rule]:
    """An audit record: known domains, S0 exactly for clean records, S4 exactly for conflicts with the label."""
    clean = F.size("tags") == 0
    return [
        Rule("unknown_severity", F.coalesce(~F.col("severity").isin(*SEVERITIES), F.lit(True))),
        Rule("unknown_alignment", F.coalesce(~F.col("alignment").isin(*ALIGNMENTS), F.lit(True))),
        Rule("s0_with_tags", (F.col("severity") == "S0") & ~clean),
        Rule("tags_without_severity", (F.col("severity") != "S0") & clean & (F.col("alignment") != "semantic_conflict")),
        Rule("conflict_below_s4", (F.col("alignment") == "semantic_conflict") & (F.col("severity") != "S4")),
        Rule("tags_not_sorted", F.array_sort("tags") != F.col("tags")),
    ]


def run_rules() -> list[Rule]:
    """A run's own report against its records: counts agree and stay within the shard."""
    return [
        Rule("count_differs", F.col("declared") != F.col("n")),
        Rule("failed_differs", F.col("declared_failed") != F.col("n_failed")),
        Rule("bad_shard", ~F.col("shard").between(0, F.col("n_shards") - 1)),
    ]


def lead_in_pattern(phrase: str) -> str:
    """A phrase as a pattern: any white space between its words, ``m`` and ``rn`` alike."""
    return r"\s+".join(re.sub("m|rn", "(?:m|rn)", re.escape(w)) for w in phrase.split())


def recovered_queries(blocks: DataFrame, key: list[str], lead_ins: list[str]) -> DataFrame:
    """(key columns, status, block_id, query): the text behind the one lead-in of a document.

    A document without a lead-in, or with several, is undetermined and says why.
    """
    pattern = "|".join(lead_in_pattern(p) for p in lead_ins)
    pieces = F.split("text", f"(?is)(?:{pattern})")
    hits = blocks.where("text IS NOT NULL").select(*key, "block_id", F.posexplode(pieces).alias("at", "query")).where("at > 0")
    hits = hits.withColumn("query", F.trim("query")).where("query != ''")
    per = hits.groupBy(*key).agg(F.count("*").alias("n"), F.min("block_id").alias("block_id"), F.min("query").alias("query"))
    every = blocks.select(*key).distinct().join(per, key, "left")
    status = F.when(F.col("n").isNull(), "no_match").when(F.col("n") > 1, "several_matches").otherwise("recovered")
    one = F.col("n") == 1
    return every.select(*key, status.alias("status"), F.when(one, F.col("block_id")).alias("block_id"), F.when(one, F.col("query")).alias("query"))


def html_blocks(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key columns, seq, block_id, text): labelled spans b01 to b23 of plain or tagged output, entities decoded."""
    text = F.regexp_replace(column, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.replace(text, F.lit("<|user|>"), F.lit(""))
    marked = F.regexp_replace(text, r"(?i)\b(b(?:0[1-9]|1[0-9]|2[0-3]))\s*:\s*", "\x1e$1\x1f")
    parts = df.select(*key, F.posexplode(F.split(marked, "\x1e")).alias("seq", "piece")).where("seq > 0")
    body = F.trim(F.regexp_replace(F.substring_index("piece", "\x1f", -1), r"(?U)\s+", " "))
    return parts.select(*key, F.col("seq").cast("long").alias("seq"), F.lower(F.substring_index("piece", "\x1f", 1)).alias("block_id"), body.alias("text"))
