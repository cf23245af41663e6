"""Question screens, answer equality, arithmetic support, severity and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import arithmetic as A
from quillframe.operators import plan as P
from quillframe.operators import screen as S
from quillframe.plans import inputs
from quillframe.plans.inputs import sql
from quillframe.plans.registry import Registry
from quillframe.session import table

query = Registry()

_FLAT = "trim(regexp_replace(user_query, '\\s+', ' ', 'g'))"
_SIGNAL_SQL = ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{c}' END" for c, p in S.SIGNALS.items())


def _flat(df):
    return df.withColumn("q", F.trim(F.regexp_replace("user_query", r"\s+", " ")))


@query(sql(f"t|s AS (SELECT instance_id, {_FLAT} AS q FROM t WHERE user_query IS NOT NULL)",
    f"""SELECT instance_id, array_to_string(list_filter([{_SIGNAL_SQL},
 CASE WHEN regexp_matches(q, '(?i)\\b(?:each|per)\\b') AND len(regexp_extract_all(q, '{S.NUMBER}')) >= 3 THEN 'cardinality_cue' END,
 CASE WHEN len(regexp_extract_all(q, '{S.RATE}')) >= 2 THEN 'multiple_rate_cues' END,
 CASE WHEN length(q) - length(replace(q, '?', '')) > 1 THEN 'multiple_question_marks' END], lambda x: x IS NOT NULL), ',') AS signals FROM s"""))  # fmt: skip
def lexical_signals(spark, d):
    t = _flat(inputs.tasks(spark, d).where("user_query IS NOT NULL"))
    return t.select("instance_id", F.array_join(S.signals(F.col("q")), ",").alias("signals"))


@query(sql(f"t|s AS (SELECT instance_id, {_FLAT} AS q FROM t WHERE user_query IS NOT NULL)",
    """SELECT instance_id, regexp_matches(q, '(?i)\\b(?:last|remaining)\\b.*\\b(?:last|remaining)\\b') AS quantifier, regexp_matches(q, '(?i)\\b(?:unrelated|irrelevant)\\b') AS distractor,
 regexp_matches(q, '\\b\\d+(?:\\.\\d+)?\\s*=\\s*\\d+\\b|\\b(?:it|to|the)[a-z]{8,}\\b') AS glued FROM s"""))  # fmt: skip
def structural_tags(spark, d):
    t = _flat(inputs.tasks(spark, d).where("user_query IS NOT NULL")).withColumn("tags", S.tags(F.col("q")))
    has = lambda x: F.array_contains("tags", x)
    return t.select("instance_id", has("quantifier_scope_last_remaining").alias("quantifier"), has("distractor_operand_interference").alias("distractor"), has("extraction_or_ocr_uncertain").alias("glued"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN 'ratio_share' ELSE 'constant_rate_coverage' END AS method,
 round(CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN l_quantity * 3.0 / (3 + l_linenumber) ELSE l_quantity * l_linenumber / 4.0 END, 6) AS "value" FROM lineitem""")
def computed_answers(spark, d):
    """Closed-form answers of questions written from the order lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("k"))
    ratio = F.format_string("Mix the ratio of 3 parts honey to %d parts water and make %d liters in total.", "l_linenumber", "k")
    cover = F.format_string("It takes %d minutes to cover every 4 miles and the road is %d miles long.", "l_linenumber", "k")
    method, value = S.computed_answer(F.when(F.col("k") % 2 == 0, ratio).otherwise(cover))
    return li.select("l_orderkey", "l_linenumber", method.alias("method"), F.round(value, 6).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity <> 2 * l_linenumber AS conflict FROM lineitem""")
def rate_conflicts(spark, d):
    """A stated hourly rate against the one an interval implies, in sentences written from the order lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("k"))
    q = F.format_string("The belt moves at a rate of %d boxes per hour, and each 30-minute interval covers %d boxes.", "k", "l_linenumber")
    return li.select("l_orderkey", "l_linenumber", S.rate_conflict(q).alias("conflict"))


@query(sql("q|n AS (SELECT instance_id, answer, TRY_CAST(replace(trim(answer), ',', '') AS DECIMAL(38,18)) AS v, lower(replace(trim(answer), ',', '')) AS s FROM q)",
    """SELECT a.instance_id, a.answer AS left_answer, b.answer AS right_answer, CASE WHEN a.answer IS NULL OR b.answer IS NULL THEN a.answer IS NULL AND b.answer IS NULL WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN a.v = b.v ELSE a.s = b.s END AS same
 FROM n a JOIN n b ON a.instance_id = b.instance_id"""))  # fmt: skip
def answer_equality(spark, d):
    q = inputs.labels(spark, d).select("instance_id", "answer")
    joined = q.withColumnRenamed("answer", "left_answer").join(q.withColumnRenamed("answer", "right_answer"), "instance_id")
    return joined.select("instance_id", "left_answer", "right_answer", A.same_answer(F.col("left_answer"), F.col("right_answer")).alias("same"))


@query()
def equation_support(spark, d):
    """Canonical proofs of line totals: quantity times price, written in two orders."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("k"), F.col("l_linenumber").cast("long").alias("m"))
    total = F.col("k") * F.col("m")
    first = F.format_string("total: %d * %d = %d", "k", "m", total)
    second = F.format_string("check %d / %d = %d; %d * %d = %d", total, "m", "k", "m", "k", total)
    answer = total.cast("string")
    rows = li.select("l_orderkey", "l_linenumber", first.alias("a"), second.alias("b"), answer.alias("answer"))
    proved = rows.select("l_orderkey", "l_linenumber", A.supporting_clauses(F.col("a"), F.col("answer")).alias("proof"), A.supporting_clauses(F.col("b"), F.col("answer"), True).alias("check"))
    independent = (F.size("proof") > 0) & (F.size("check") > 0) & ~F.arrays_overlap("proof", "check")
    return proved.select("l_orderkey", "l_linenumber", F.array_join("proof", ";").alias("proof"), F.array_join("check", ";").alias("verification"), independent.alias("independent"))


@query(sql("t q|s AS (SELECT collection_id, instance_id, answer, trim(regexp_replace(regexp_replace(lower(user_query), '\\d+(\\.\\d+)?', '#', 'g'), '\\s+', ' ', 'g')) AS k FROM t JOIN q USING (instance_id) WHERE user_query IS NOT NULL), g AS (SELECT *, lag(k) OVER w AS bk, lag(answer) OVER w AS ba, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY collection_id ORDER BY instance_id, answer NULLS FIRST))",
    "SELECT collection_id, instance_id, answer, i > 1 AND coalesce(k = bk, false) AND answer IS NOT DISTINCT FROM ba AS carried FROM g"))
def label_carryover(spark, d):
    t = inputs.tasks(spark, d).where("user_query IS NOT NULL").select("collection_id", "instance_id", F.trim(F.regexp_replace(F.regexp_replace(F.lower("user_query"), r"\d+(\.\d+)?", "#"), r"\s+", " ")).alias("k"))
    rows = t.join(inputs.labels(spark, d).select("instance_id", "answer"), "instance_id").withColumn("conflict", F.lit(True))
    rows = rows.withColumn("o", F.coalesce("answer", F.lit("")))
    return S.carried_over(rows, ["collection_id"], ["instance_id", "o"], ["k", "answer"], "conflict").select("collection_id", "instance_id", "answer", "carried")


_PASSES = "p AS (SELECT instance_id, n AS pass_no, CASE WHEN n = 2 AND ascii(right(instance_id, 1)) % 5 = 0 THEN answer || '0' ELSE answer END AS answer, list_sort(evidence) AS evidence FROM q, (SELECT unnest([1, 2, 3]) AS n))"


def _passes(spark, d):
    """Three review passes made from the labels; the second differs where the last digit of the id is 0 or 5."""
    q = inputs.labels(spark, d).select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pass_no"))
    flip = (F.col("pass_no") == 2) & (F.ascii(F.right("instance_id", F.lit(1))) % 5 == 0)
    return q.select("instance_id", "pass_no", F.when(flip, F.concat("answer", F.lit("0"))).otherwise(F.col("answer")).alias("answer"), F.array_sort("evidence").alias("evidence"))


@query(sql(f"q|{_PASSES}", "SELECT instance_id, count(DISTINCT pass_no) AS n_passes, count(DISTINCT {'a': coalesce(answer, ''), 'e': coalesce(array_to_string(evidence, ','), '')}) AS n_decisions, count(DISTINCT pass_no) = 3 AND count(DISTINCT {'a': coalesce(answer, ''), 'e': coalesce(array_to_string(evidence, ','), '')}) = 1 AS unanimous FROM p GROUP BY 1"))
def consensus_unanimous(spark, d):
    p = _passes(spark, d).select("instance_id", "pass_no", F.coalesce("answer", F.lit("")).alias("a"), F.coalesce(F.array_join("evidence", ","), F.lit("")).alias("e"))
    return P.unanimous(p, "instance_id", ["a", "e"], 3)


@query(sql(f"q|{_PASSES}, w AS (SELECT x.instance_id, x.answer IS NOT DISTINCT FROM y.answer AS same, len(x.evidence) > 0 AND x.answer IS NOT NULL AS reliable, ascii(right(x.instance_id, 1)) % 10 = 0 AS confirmed FROM (SELECT DISTINCT * FROM p WHERE pass_no = 1) x JOIN (SELECT DISTINCT * FROM p WHERE pass_no = 2) y ON x.instance_id = y.instance_id)",
    "SELECT instance_id, CASE WHEN same AND coalesce(reliable, false) THEN 'confirmed' WHEN NOT same AND confirmed THEN 'excluded' WHEN coalesce(reliable, false) THEN 'candidate' ELSE 'needs_review' END AS bucket, count(*) AS n FROM w GROUP BY 1, 2"))
def review_routing(spark, d):
    p = _passes(spark, d).distinct()
    x = p.where("pass_no = 1").select("instance_id", "answer", "evidence")
    y = p.where("pass_no = 2").select("instance_id", F.col("answer").alias("other"))
    reliable = F.coalesce((F.size("evidence") > 0) & F.col("answer").isNotNull(), F.lit(False))
    confirmed = F.ascii(F.right("instance_id", F.lit(1))) % 10 == 0
    bucket = P.route(F.col("answer").eqNullSafe(F.col("other")), reliable, confirmed)
    return x.join(y, "instance_id").select("instance_id", bucket.alias("bucket")).groupBy("instance_id", "bucket").agg(F.count("*").alias("n"))


QUERIES, SQL = query.queries, query.sql
