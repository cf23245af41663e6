"""Fail-closed validation: rules give a table of violations first, and a gate that raises second."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for a row that violates the rule; null counts as not broken."""

    name: str
    broken: Column


class GateError(ValueError):
    """A gate found violations."""


def violations(df: DataFrame, key: list[str], rules: list[Rule]) -> DataFrame:
    """(key columns, rule): one row per row and violated rule, all rules in one pass."""
    found = F.filter(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return df.select(*key, F.explode(found).alias("rule"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def coverage(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that are missing from or extra in ``seen``."""
    a, b = expected.select(key).distinct(), seen.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("extra")))


def gate(found: DataFrame, what: str, show: int = 5) -> None:
    """Raise if there is any violation; the message names the first few."""
    rows = found.limit(show).collect()
    if rows:
        raise GateError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


# Typed predicates over text values.
def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_commit(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{40}$")


def is_task_id(c: Column) -> Column:
    return c.rlike("^task_[0-9]{6}$")


def is_block_id(c: Column) -> Column:
    return c.rlike("^b[0-9]{2}$")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))) & (c >= 0)


def is_safe_path(c: Column) -> Column:
    """Relative, inside its root, with no parent steps and no drive."""
    return c.isNotNull() & (c != "") & ~c.rlike(r"^(/|\\|[A-Za-z]:)") & ~c.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def submission_rules() -> list[Rule]:
    """Answers have no blanks; evidence is a non-empty list of distinct block ids."""
    answer, evidence = F.col("answer"), F.col("evidence")
    return [
        Rule("bad_id", F.coalesce(F.col("instance_id") == "", F.lit(True))),
        Rule("bad_answer", F.coalesce(~answer.rlike(r"^\S+$"), F.lit(True))),
        Rule("empty_evidence", F.coalesce(F.size(evidence) == 0, F.lit(True)) | (F.size(evidence) < 0)),
        Rule("bad_block_id", F.exists(evidence, lambda b: F.coalesce(~is_block_id(b), F.lit(True)))),
        Rule("repeated_block_id", F.forall(evidence, lambda b: F.coalesce(is_block_id(b), F.lit(False))) & (F.size(F.array_distinct(evidence)) < F.size(evidence))),
    ]


def record_rules() -> list[Rule]:
    """A record that is ok has pages and no error; one that failed has an error, its kind and no pages."""
    ok, failed = F.col("status") == "ok", F.col("status") == "failed"
    pages = F.coalesce(F.greatest(F.size("pages"), F.lit(0)), F.lit(0))
    return [
        Rule("unknown_status", F.coalesce(~F.col("status").isin("ok", "failed"), F.lit(True))),
        Rule("ok_without_pages", ok & (pages == 0)),
        Rule("ok_with_error", ok & (F.col("error").isNotNull() | F.col("error_kind").isNotNull())),
        Rule("failed_without_error", failed & (F.col("error").isNull() | F.col("error_kind").isNull())),
        Rule("failed_with_pages", failed & (pages > 0)),
        Rule("pages_not_ascending", F.array_sort(F.transform("pages", lambda p: p["page_number"])) != F.transform("pages", lambda p: p["page_number"])),
        Rule("bad_page", F.exists("pages", lambda p: (p["page_number"] < 1) | (p["width"] <= 0) | (p["height"] <= 0))),
        Rule("bad_timing", F.exists(F.map_values("timing"), lambda v: F.coalesce((v < 0) | F.isnan(v), F.lit(True)))),
    ]


def line_rules() -> list[Rule]:
    """Boxes are not negative and inside the page, confidences lie in 0..1, pages count from 1."""
    box = F.col("bbox")
    return [
        Rule("bad_page", F.col("page_number") < 1),
        Rule("bad_order", F.col("source_order") < 0),
        Rule("bad_confidence", (F.col("confidence") < 0) | (F.col("confidence") > 1)),
        Rule("negative_box", (box["left"] < 0) | (box["top"] < 0) | (box["width"] < 0) | (box["height"] < 0)),
        Rule("box_off_page", (box["left"] + box["width"] > F.col("page_width")) | (box["top"] + box["height"] > F.col("page_height"))),
        Rule("bad_block_id", ~F.col("block_id").rlike("^b[0-9]{2,}$")),
    ]


# What a report must not claim without an experiment, in four forms.
CLAIMS = (
    r"(?i)\b\d+(?:\.\d+)?%\s*(?:improved|improvement|better|higher|lower|gain(?:ed)?|increase(?:d)?|decrease(?:d)?|accuracy|precision|recall|향상|개선|증가|감소|달성)\b",
    r"(?i)\b(?:accuracy|precision|recall|f1|auroc|auprc|score|performance)\s*(?:=|:|was|is|rose|reached|increased|decreased|improved)\s*\d+(?:\.\d+)?%?",
    r"(?:정확도|정밀도|재현율|점수|성능|F1|AUROC|AUPRC)\s*(?:가|는|은|:|=)?\s*\d+(?:\.\d+)?%?\s*(?:였다|이다|달성했다|향상됐다|향상되었다|개선됐다|개선되었다|증가했다|감소했다)",
    r"(?:실측값|실측 결과|측정 결과)\s*(?:은|는|:|=)\s*[^\n]*\d+(?:\.\d+)?",
)


def claims(text: Column) -> list[Column]:
    """Whether a text makes a claim of each form; word limits are those of Unicode."""
    return [text.rlike(f"(?U){p}") for p in CLAIMS]
