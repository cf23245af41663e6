"""Fail-closed checks: every rule as violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import rules
from quillframe.plans import inputs
from quillframe.plans.inputs import sql
from quillframe.plans.registry import Registry
from quillframe.session import table

query = Registry()


def _cases(pairs: list[tuple[str, str]], key: str, source: str) -> str:
    """SQL that lists violated rules of a relation."""
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS rule FROM {source} WHERE {broken}" for name, broken in pairs)


@query(sql("q", _cases([
    ("bad_id", "coalesce(instance_id = '', true)"),
    ("bad_answer", "coalesce(NOT regexp_full_match(answer, '\\S+'), true)"),
    ("empty_evidence", "coalesce(len(evidence) = 0, true)"),
    ("bad_block_id", "len(list_filter(evidence, lambda x: coalesce(NOT regexp_full_match(x, 'b[0-9]{2}'), true))) > 0"),
    ("repeated_block_id", "len(list_filter(evidence, lambda x: coalesce(NOT regexp_full_match(x, 'b[0-9]{2}'), true))) = 0 AND len(list_distinct(evidence)) < len(evidence)"),
], "instance_id", "q")))
def submission_violations(spark, d):
    return rules.violations(inputs.labels(spark, d), ["instance_id"], rules.submission_rules())


@query(sql("rec", _cases([
    ("unknown_status", "coalesce(status NOT IN ('ok', 'failed'), true)"),
    ("ok_without_pages", "status = 'ok' AND coalesce(len(pages), 0) = 0"),
    ("ok_with_error", "status = 'ok' AND (error IS NOT NULL OR error_kind IS NOT NULL)"),
    ("failed_without_error", "status = 'failed' AND (error IS NULL OR error_kind IS NULL)"),
    ("failed_with_pages", "status = 'failed' AND coalesce(len(pages), 0) > 0"),
    ("pages_not_ascending", "list_sort(list_transform(pages, lambda p: p.page_number)) <> list_transform(pages, lambda p: p.page_number)"),
    ("bad_page", "len(list_filter(pages, lambda p: p.page_number < 1 OR p.width <= 0 OR p.height <= 0)) > 0"),
    ("bad_timing", "len(list_filter(map_values(timing), lambda v: coalesce(v < 0 OR isnan(v), true))) > 0"),
], "instance_id, engine", "rec")))
def ocr_record_violations(spark, d):
    return rules.violations(inputs.records(spark, d), ["instance_id", "engine"], rules.record_rules())


@query(sql("l", _cases([
    ("bad_page", "page_number < 1"), ("bad_order", "source_order < 0"), ("bad_confidence", "confidence < 0 OR confidence > 1"),
    ("negative_box", "bbox.left < 0 OR bbox.top < 0 OR bbox.width < 0 OR bbox.height < 0"),
    ("box_off_page", "bbox.left + bbox.width > page_width OR bbox.top + bbox.height > page_height"),
    ("bad_block_id", "NOT regexp_full_match(block_id, 'b[0-9]{2,}')"),
], "instance_id, engine, page_number, source_order", "l")))
def line_violations(spark, d):
    return rules.violations(inputs.lines(spark, d), ["instance_id", "engine", "page_number", "source_order"], rules.line_rules())


@query(sql("r", _cases([
    ("bad_index", "coalesce(model_index < 1, true)"), ("failed_with_output", "status = 'failed' AND raw_output IS NOT NULL"), ("ok_without_output", "status = 'ok' AND raw_output IS NULL"),
    ("bad_sha", "raw_output_sha256 IS NOT NULL AND NOT regexp_full_match(raw_output_sha256, '[0-9a-f]{64}')"),
    ("sha_differs", "raw_output_sha256 <> sha256(raw_output)"), ("bytes_differ", "raw_output_bytes <> strlen(raw_output)"),
    ("bad_latency", "coalesce(isnan(doc_latency_sec) OR doc_latency_sec < 0, false)"), ("success_disagrees", "success <> (status = 'ok')"),
], "instance_id, model_index", "r")))
def result_violations(spark, d):
    status, raw = F.col("status"), F.col("raw_output")
    checks = [
        rules.Rule("bad_index", F.coalesce(F.col("model_index") < 1, F.lit(True))), rules.Rule("failed_with_output", (status == "failed") & raw.isNotNull()), rules.Rule("ok_without_output", (status == "ok") & raw.isNull()),
        rules.Rule("bad_sha", ~rules.is_sha256(F.col("raw_output_sha256"))), rules.Rule("sha_differs", F.col("raw_output_sha256") != F.sha2(raw, 256)),
        rules.Rule("bytes_differ", F.col("raw_output_bytes") != F.octet_length(raw)), rules.Rule("bad_latency", F.isnan("doc_latency_sec") | (F.col("doc_latency_sec") < 0)),
        rules.Rule("success_disagrees", F.col("success") != (status == "ok")),
    ]
    return rules.violations(inputs.results(spark, d), ["instance_id", "model_index"], checks)


@query(sql("t", _cases([
    ("bad_id", "coalesce(NOT regexp_full_match(instance_id, 'task_[0-9]{6}'), true)"), ("no_query", "coalesce(trim(user_query) = '', true)"),
    ("bad_sha", "coalesce(NOT regexp_full_match(input_pdf_sha256, '[0-9a-f]{64}'), true)"),
    ("unsafe_path", "document_pdf = '' OR regexp_matches(document_pdf, '^(/|\\\\|[A-Za-z]:)') OR regexp_matches(document_pdf, '(^|[/\\\\])\\.\\.([/\\\\]|$)') OR document_pdf IS NULL"),
    ("no_seed", "split_seed IS NULL"),
], "instance_id", "t")))
def manifest_violations(spark, d):
    checks = [
        rules.Rule("bad_id", F.coalesce(~rules.is_task_id(F.col("instance_id")), F.lit(True))), rules.Rule("no_query", F.coalesce(F.trim("user_query") == "", F.lit(True))),
        rules.Rule("bad_sha", F.coalesce(~rules.is_sha256(F.col("input_pdf_sha256")), F.lit(True))), rules.Rule("unsafe_path", ~rules.is_safe_path(F.col("document_pdf"))),
        rules.Rule("no_seed", F.col("split_seed").isNull()),
    ]
    return rules.violations(inputs.tasks(spark, d), ["instance_id"], checks)


@query("""SELECT event_id, len(list_filter(json_keys(props), lambda k: k IN ('answer', 'evidence', 'labels', 'candidate_answers', 'portal_score', 'portal_scores'))) > 0 AS leaks FROM events WHERE json_valid(props)""")
def leak_columns(spark, d):
    from quillframe.sources.sinks import FORBIDDEN

    e = table(spark, d, "events").where(F.try_parse_json("props").isNotNull())
    return e.select("event_id", F.arrays_overlap(F.json_object_keys("props"), F.array(*[F.lit(x) for x in sorted(FORBIDDEN)])).alias("leaks"))


@query("""SELECT event_id, json_type(props, '$') AS root, coalesce(json_type(props, '$.k') IN ('BIGINT', 'UBIGINT'), false) AS k_is_integer FROM events WHERE json_valid(props)""")
def type_predicates(spark, d):
    e = table(spark, d, "events").withColumn("v", F.try_parse_json("props")).where("v IS NOT NULL")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.k", "variant"))
    root = F.when(F.schema_of_variant("v").startswith("OBJECT"), "OBJECT").when(F.schema_of_variant("v").startswith("ARRAY"), "ARRAY").otherwise(F.schema_of_variant("v"))
    return e.select("event_id", root.alias("root"), F.coalesce(kind == "BIGINT", F.lit(False)).alias("k_is_integer"))


@query(sql("rec", """SELECT engine, CASE WHEN status = 'ok' THEN 'none' WHEN error ILIKE '%timeout%' OR error ILIKE '%timed out%' THEN 'timeout' WHEN error ILIKE '%not found%' OR error ILIKE '%no such%' THEN 'missing'
 WHEN error IS NULL THEN 'unknown' ELSE 'other' END AS error_class, count(*) AS n FROM rec GROUP BY 1, 2"""))
def error_kind_counts(spark, d):
    e = F.lower("error")
    kind = (
        F.when(F.col("status") == "ok", "none").when(e.contains("timeout") | e.contains("timed out"), "timeout")
        .when(e.contains("not found") | e.contains("no such"), "missing").when(e.isNull(), "unknown").otherwise("other")
    )
    return inputs.records(spark, d).groupBy("engine", kind.alias("error_class")).agg(F.count("*").alias("n"))


@query(sql("rec|k AS (SELECT instance_id, engine, page_number, row_number() OVER (PARTITION BY instance_id, engine ORDER BY page_number) AS i FROM (SELECT instance_id, engine, unnest(list_transform(pages, lambda p: p.page_number)) AS page_number FROM rec))",
    "SELECT instance_id, engine, count(*) AS n_pages, bool_and(page_number = i) AS consecutive FROM k GROUP BY 1, 2"))
def consecutive_pages(spark, d):
    numbers = F.array_sort(F.transform("pages", lambda p: p["page_number"]))
    r = inputs.records(spark, d).where(F.size("pages") > 0)
    return r.select("instance_id", "engine", F.size("pages").cast("long").alias("n_pages"), (numbers == F.sequence(F.lit(1), F.size("pages"))).alias("consecutive"))


@query(sql("t|j AS (SELECT instance_id, CASE WHEN user_query IS NULL THEN '' ELSE user_query END AS line FROM t)",
    "SELECT instance_id, trim(line) = '' AS blank, CAST(length(line) AS BIGINT) AS n FROM j WHERE trim(line) = '' OR NOT json_valid(line)"))
def jsonl_strict_lines(spark, d):
    t = inputs.tasks(spark, d).select("instance_id", F.coalesce("user_query", F.lit("")).alias("line"))
    from quillframe.sources.jsonl import is_json

    bad = (F.trim("line") == "") | ~is_json(F.col("line"))
    return t.where(bad).select("instance_id", (F.trim("line") == "").alias("blank"), F.length("line").cast("long").alias("n"))


@query(sql("r|g AS (SELECT instance_id, count(*) AS n, count(DISTINCT model_index) AS k, min(model_index) AS lo, max(model_index) AS hi FROM r GROUP BY 1)",
    "SELECT instance_id, n, k = n AS unique_index, lo >= 1 AS starts_well, count(*) OVER (PARTITION BY n) AS n_like FROM g"))
def group_uniformity(spark, d):
    g = inputs.results(spark, d).groupBy("instance_id").agg(F.count("*").alias("n"), F.countDistinct("model_index").alias("k"), F.min("model_index").alias("lo"))
    sizes = g.groupBy("n").agg(F.count("*").alias("n_like"))  # a small table; a window over n would be one task per size
    return g.join(F.broadcast(sizes), "n").select("instance_id", "n", (F.col("k") == F.col("n")).alias("unique_index"), (F.col("lo") >= 1).alias("starts_well"), "n_like")

#: Texts with a claim of each form, beside the stored documents.
_CLAIMS = [(-1, "It is 12% better."), (-2, "12.5% 향상 후"), (-3, "Accuracy was 91"), (-4, "정확도는 91% 달성했다"), (-5, "측정 결과: 약 3.5 초"), (-6, "12 percent better, accuracy high"), (-7, "F1 reached 0.9 at last")]
_EDGE = r"[^\p{L}\p{N}_]"


def _sql_claim(pattern: str) -> str:
    """The pattern for an engine whose word limits are those of ASCII."""
    flag, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    head, tail = rest.startswith(r"\b"), rest.endswith(r"\b")
    rest = rest.removeprefix(r"\b").removesuffix(r"\b")
    return flag + (f"(?:^|{_EDGE})" if head else "") + rest + (f"(?:$|{_EDGE})" if tail else "")


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in _CLAIMS)}))
 SELECT doc_id, {", ".join(f"regexp_matches(text, '{_sql_claim(p)}') AS claim_{k}" for k, p in enumerate(rules.CLAIMS, 1))} FROM d""")
def contract_checks(spark, d):
    """Which forms of unproven claims a text makes."""
    made = spark.createDataFrame(_CLAIMS, "doc_id long, text string")
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").unionByName(made)
    return docs.select("doc_id", *[c.alias(f"claim_{k}") for k, c in enumerate(rules.claims(F.col("text")), 1)])


QUERIES, SQL = query.queries, query.sql
