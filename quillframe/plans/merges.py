"""Shard merges, review shards and overlays, composite scores; every query over stored tables plus rows that break each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import evaluate as E
from quillframe.operators import merge as M
from quillframe.operators import plan as P
from quillframe.operators import screen as S
from quillframe.plans import inputs
from quillframe.plans.inputs import sql
from quillframe.plans.registry import Registry

query = Registry()

# --- shard merge ----------------------------------------------------------------------------------------------------

SEED, SHARDS = "quillframe-merge-1", 4
_RUN_ROWS = [
    # shard, added to the record count, added to the failed count, dirty, machine
    (0, 0, 0, False, "x1"), (1, 0, 0, True, "x1"), (2, 0, 1, False, "x2"), (3, 1, 0, False, "x1"), (5, 0, 0, False, "x1"),
]


def _fault(name: str):
    """A hexadecimal digit of an id; the digits decide which planted fault a record has."""
    return F.substring(F.sha2(F.concat(F.lit(f"{name}:"), F.col("instance_id")), 256), 1, 1)


def _manifest(spark, d):
    t = inputs.tasks(spark, d).where("input_pdf_sha256 IS NOT NULL")
    one = t.groupBy("instance_id").agg(F.min("user_query").alias("user_query"), F.min("input_pdf_sha256").alias("pdf_sha"))
    return P.shards(one, "instance_id", SEED, SHARDS, F.col("pdf_sha")).select("instance_id", "shard", "user_query", "pdf_sha")


def _shard_results(manifest):
    """Records of every shard: some lost, moved, doubled, altered, failed or from another configuration, one unknown."""
    f = _fault("fault")
    kept = manifest.where(f != "0")
    moved = F.when(f == "1", (F.col("shard") + 1) % SHARDS).otherwise(F.col("shard"))
    rows = kept.select(
        moved.cast("int").alias("shard"), "instance_id", F.when(f == "3", F.concat("user_query", F.lit("?"))).otherwise(F.col("user_query")).alias("user_query"),
        F.when(f == "4", F.reverse("pdf_sha")).otherwise(F.col("pdf_sha")).alias("pdf_sha"), F.when(f == "5", "failed").otherwise("ok").alias("status"),
        F.when(f == "6", "dpi=300").otherwise("dpi=200").alias("configuration"), f.alias("f"),
    )
    again = rows.where("f = '2'").withColumn("shard", (F.col("shard") + 2) % SHARDS)
    unknown = manifest.sparkSession.createDataFrame([(0, "task_x", "q", "s", "ok", "dpi=200")], "shard int, instance_id string, user_query string, pdf_sha string, status string, configuration string")
    return rows.unionByName(again).drop("f").unionByName(unknown)


def _runs(spark, results):
    told = spark.createDataFrame(_RUN_ROWS, "shard int, more int, more_failed int, dirty boolean, machine string")
    held = results.groupBy("shard").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "failed", 1)).alias("nf"))
    j = told.join(held, "shard", "left")
    return j.select("shard", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("record_count"), (F.coalesce("nf", F.lit(0)) + F.col("more_failed")).alias("failed_count"), "dirty", F.lit("1.0").alias("schema_version"), "machine", F.lit("r1").alias("revision"), F.lit("m1").alias("manifest_sha"))


_MERGE = f"""m AS (SELECT instance_id, user_query, pdf_sha, CAST((row_number() OVER (ORDER BY sha256('{SEED}' || chr(0) || instance_id || chr(0) || pdf_sha), instance_id) - 1) % {SHARDS} AS INTEGER) AS shard,
  substr(sha256('fault:' || instance_id), 1, 1) AS f FROM (SELECT instance_id, min(user_query) AS user_query, min(input_pdf_sha256) AS pdf_sha FROM t WHERE input_pdf_sha256 IS NOT NULL GROUP BY 1)),
 r0 AS (SELECT CASE WHEN f = '1' THEN (shard + 1) % {SHARDS} ELSE shard END AS shard, instance_id, CASE WHEN f = '3' THEN user_query || '?' ELSE user_query END AS user_query,
  CASE WHEN f = '4' THEN reverse(pdf_sha) ELSE pdf_sha END AS pdf_sha, CASE WHEN f = '5' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN f = '6' THEN 'dpi=300' ELSE 'dpi=200' END AS configuration, f FROM m WHERE f <> '0'),
 r AS (SELECT * EXCLUDE f FROM r0 UNION ALL SELECT (shard + 2) % {SHARDS}, instance_id, user_query, pdf_sha, status, configuration FROM r0 WHERE f = '2' UNION ALL SELECT 0, 'task_x', 'q', 's', 'ok', 'dpi=200'),
 h AS (SELECT shard, count(*) AS n, count(*) FILTER (status = 'failed') AS nf FROM r GROUP BY 1),
 u AS (SELECT v.shard, coalesce(n, 0) + more AS record_count, coalesce(nf, 0) + more_failed AS failed_count, dirty, machine, coalesce(n, 0) AS n, coalesce(nf, 0) AS nf
  FROM (VALUES {", ".join(f"({a}, {b}, {c}, {str(e).lower()}, '{g}')" for a, b, c, e, g in _RUN_ROWS)}) v(shard, more, more_failed, dirty, machine) LEFT JOIN h USING (shard)),
 x AS (SELECT instance_id AS subject, 'unexpected_id' AS rule FROM r WHERE instance_id NOT IN (SELECT instance_id FROM m)
  UNION SELECT r.instance_id, 'wrong_shard' FROM r JOIN m USING (instance_id) WHERE r.shard <> m.shard
  UNION SELECT instance_id, 'duplicate_id' FROM r GROUP BY 1 HAVING count(*) > 1
  UNION SELECT r.instance_id, 'query_differs' FROM r JOIN m USING (instance_id) WHERE r.user_query IS DISTINCT FROM m.user_query
  UNION SELECT r.instance_id, 'pdf_differs' FROM r JOIN m USING (instance_id) WHERE r.pdf_sha IS DISTINCT FROM m.pdf_sha
  UNION SELECT instance_id, 'failed_record' FROM r WHERE status IS DISTINCT FROM 'ok'
  UNION SELECT instance_id, 'configuration_differs' FROM r WHERE configuration IS DISTINCT FROM (SELECT configuration FROM r ORDER BY shard, instance_id LIMIT 1)
  UNION SELECT instance_id, 'missing_id' FROM m WHERE instance_id NOT IN (SELECT instance_id FROM r)
  UNION SELECT printf('shard-%02d', shard), 'shard_out_of_range' FROM u WHERE shard NOT BETWEEN 0 AND {SHARDS - 1}
  UNION SELECT printf('shard-%02d', shard), 'run_report_missing' FROM h WHERE shard NOT IN (SELECT shard FROM u)
  UNION SELECT printf('shard-%02d', shard), 'record_count_differs' FROM u WHERE record_count <> n
  UNION SELECT printf('shard-%02d', shard), 'failed_count_differs' FROM u WHERE failed_count <> nf
  UNION SELECT printf('shard-%02d', shard), 'failed_exceeds_records' FROM u WHERE failed_count > record_count
  UNION SELECT printf('shard-%02d', shard), 'dirty_repository' FROM u WHERE dirty
  UNION SELECT printf('shard-%02d', shard), 'cohort_differs' FROM u WHERE machine <> (SELECT machine FROM u WHERE shard = 0)
  UNION SELECT printf('shard-%02d', i), 'shard_missing' FROM range({SHARDS}) s(i) WHERE i NOT IN (SELECT shard FROM r))"""


@query(sql(f"t|{_MERGE}", "SELECT subject, rule FROM x"))
def shard_merge_violations(spark, d):
    """Everything that speaks against publishing the shard results of a manifest."""
    manifest = _manifest(spark, d)
    results = _shard_results(manifest)
    return M.merge_violations(manifest, results, _runs(spark, results), SHARDS)


@query(sql(f"t|{_MERGE}", f"""SELECT r.shard, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'failed') AS n_failed, count(m.instance_id) AS n_bound, count(*) FILTER (m.shard = r.shard) AS n_in_place,
 any_value(u.record_count) AS declared, any_value(u.record_count) = count(*) AS agrees FROM r LEFT JOIN m USING (instance_id) LEFT JOIN u ON u.shard = r.shard GROUP BY 1"""))
def cloud_merge_report(spark, d):
    """Results joined with manifest and run reports: how many records of a shard are bound, in place and declared."""
    manifest = _manifest(spark, d)
    results = _shard_results(manifest)
    known = manifest.select("instance_id", F.col("shard").alias("assigned"))
    per = results.join(known, "instance_id", "left").groupBy("shard").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("status") == "ok", 1)).alias("n_ok"), F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"),
        F.count("assigned").alias("n_bound"), F.count(F.when(F.col("assigned") == F.col("shard"), 1)).alias("n_in_place"),
    )
    return per.join(_runs(spark, results).select("shard", F.col("record_count").alias("declared")), "shard", "left").withColumn("agrees", F.col("declared") == F.col("n"))


# --- review shards ----------------------------------------------------------------------------------------------------

_RANGES = [
    # shard, first, last, severity, tags, declared number of overrides
    ("r1", 1, 40, "S0", ["clean"], 4), ("r2", 35, 80, "S0", ["clean"], 2), ("r3", 81, 90, "S1", ["distractor"], 1), ("r4", 91, 120, "S0", ["clean"], 3),
]
_OVERRIDES = [
    ("r1", "task_000003", "S3", ["rate_unit_corruption"]), ("r1", "task_000007", "S2", ["distractor", "ocr_uncertainty"]), ("r1", "task_000009", "S0", ["clean"]), ("r1", "task_000099", "S1", ["role_attribution"]),
    ("r2", "task_000040", "S4", ["comparison_sign_direction"]), ("r2", "task_000041", "S2", ["implicit_assumption", "implicit_default_assumption"]),
    ("r3", "task_000085", "S2", ["abs_sign_normalization"]), ("r4", "task_000100", "S1", ["ordinal_mismatch"]), ("r4", "task_000100", "S1", ["ordinal_mismatch"]), ("r4", "odd-id", "S2", ["distractor"]),
]


def _list(tags):
    return "[" + ", ".join(f"'{t}'" for t in tags) + "]"


_ALIAS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in M.TAG_ALIASES.items()) + "}"
_RESOLVED = "list_sort(list_distinct(list_transform(TAGS, lambda x: coalesce(" + _ALIAS + "[x], x))))"
_REVIEWS = f"""ra(shard, first, last, severity, tags, expected) AS (VALUES {", ".join(f"('{a}', {b}, {c}, '{e}', {_list(g)}, {n})" for a, b, c, e, g, n in _RANGES)}),
 ov AS (SELECT shard, instance_id, severity, {_RESOLVED.replace("TAGS", "tags")} AS tags FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}', {_list(g)})" for a, b, c, g in _OVERRIDES)}) v(shard, instance_id, severity, tags))"""


def _review_tables(spark):
    ranges = spark.createDataFrame(_RANGES, "shard string, first int, last int, severity string, tags array<string>, expected_overrides long")
    return ranges, spark.createDataFrame(_OVERRIDES, "shard string, instance_id string, severity string, tags array<string>")


@query(f"""WITH {_REVIEWS} SELECT i.shard, i.instance_id, coalesce(o.severity, i.severity) AS severity, array_to_string(coalesce(o.tags, {_RESOLVED.replace("TAGS", "i.tags")}), ',') AS tags
 FROM (SELECT *, printf('task_%06d', unnest(range(first, last + 1))) AS instance_id FROM ra) i LEFT JOIN (SELECT DISTINCT * FROM ov) o ON o.shard = i.shard AND o.instance_id = i.instance_id""")
def review_shard_expand(spark, d):
    """Review shards with default and override groups, one decision per id, aliases of tags resolved."""
    out = M.expanded_reviews(*_review_tables(spark))
    return out.withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {_REVIEWS}, o AS (SELECT ov.*, first, last, TRY_CAST(nullif(regexp_extract(instance_id, '^task_(\\d{{6}})$', 1), '') AS INTEGER) AS place FROM ov JOIN ra USING (shard))
 SELECT instance_id AS subject, 'override_outside_range' AS rule FROM o WHERE coalesce(NOT place BETWEEN first AND last, true)
 UNION SELECT instance_id, 'override_twice' FROM o GROUP BY shard, instance_id HAVING count(*) > 1
 UNION SELECT instance_id, 'override_not_graded' FROM o WHERE severity NOT IN ('S1', 'S2', 'S3', 'S4') OR list_contains(tags, 'clean')
 UNION SELECT shard, 'default_not_clean' FROM ra WHERE severity <> 'S0' OR tags <> ['clean']
 UNION SELECT ra.shard, 'override_count_differs' FROM ra LEFT JOIN (SELECT shard, count(DISTINCT instance_id) AS n FROM ov GROUP BY 1) c ON c.shard = ra.shard WHERE coalesce(n, 0) <> expected
 UNION SELECT DISTINCT b.shard, 'shards_overlap' FROM ra a JOIN ra b ON a.shard < b.shard AND a.first <= b.last AND b.first <= a.last""")
def review_shard_violations(spark, d):
    """Rules that review shards break, overlapping shards included."""
    return M.review_shard_violations(*_review_tables(spark))


# --- screen, label and review -----------------------------------------------------------------------------------------

#: Questions that reach every tag, solver and alignment, with a label.
_QUESTIONS = [
    ("q01", "A car keeps a rate of 60 miles per hour and each 30-minute interval covers 20 miles. How far does it get?", "120"),
    ("q02", "By what percentage more likely is red than blue?", "5"), ("q03", "She rolls a six-sided die instead of an eight-sided die. What is the chance?", None),
    ("q04", "He used 3 cups of water and 4 cups of milk. In all there is a total of 9 cups.", "9"), ("q05", "The last box and the remaining boxes are full.", "2"),
    ("q06", "An unrelated clerk counts 12 boxes.", "12"), ("q07", "Compute 3 = 4 now.", "7"), ("q08", "A 10-foot board holds 4 strips, each measuring 6 inches. What percentage is covered?", "20"),
    ("q09", "A 10-foot board holds 4 strips, each measuring 6 inches. What percentage is covered?", "20.00"), ("q10", "A 10-foot board holds 4 strips, each measuring 6 inches. What percentage is covered?", "25"),
    ("q11", "In the ratio of 2 parts salt to 3 parts sugar she mixes 50 teaspoons in total. How much salt?", "20"), ("q12", "It takes 5 minutes to cover every 2 miles and the road is 8 miles long.", "20"),
]
_N = S.NUMBER
_dec = lambda p, i=1: f"TRY_CAST(nullif(regexp_extract(q, '{p}', {i}), '') AS DECIMAL(20, 6))"
_HOURLY, _EACH = rf"(?i)(?:rate of )?({_N}) [a-z ]+ per hour", rf"(?i)each ({_N})-minute interval covers ({_N})"
_AMOUNTS = rf"(?i)used ({_N}) [^.]+ and ({_N}) [^.]+\..*?total of ({_N})"
_LENGTH = rf"(?i)(?:a|the) ({_N})[- ]foot\b.*?\b({_N})\b[^.?!]*?each (?:measuring )?({_N}) inches?[^?]*?\bpercentage"
_RATIO = rf"(?i)ratio of ({_N}) parts?\b.*?to ({_N}) parts?\b.*?({_N})\s+(?:teaspoons?|liters?) in total"
_COVER = rf"(?i)(?:takes? )?({_N}) minutes? to cover every ({_N}) (?:miles?|kilometers?|km|inches?).*?(?:is|spans?) ({_N}) (?:miles?|kilometers?|km|inches?)"
_SCREENED = f"""s AS (SELECT instance_id, trim(regexp_replace(user_query, '\\s+', ' ', 'g')) AS q, answer FROM t LEFT JOIN q USING (instance_id) WHERE user_query IS NOT NULL
  UNION ALL SELECT * FROM (VALUES {", ".join("('" + a + "', '" + b + "', " + ("NULL" if c is None else f"'{c}'") + ")" for a, b, c in _QUESTIONS)})),
 g AS (SELECT *, coalesce({_dec(_HOURLY)} * {_dec(_EACH)} <> {_dec(_EACH, 2)} * 60, false) AS rate, regexp_matches(q, '(?i)\\bpercentage more likely\\b|\\bmore likely.*expressed as a percentage\\b') AS likely,
  len(list_distinct(list_transform(regexp_extract_all(q, '(?i)\\b(?:an? )?(\\w+)-sided (?:die|spinner)\\b', 1), lambda x: lower(x)))) > 1 AND regexp_matches(q, '(?i)\\b(?:instead|for comparison|but since)\\b') AS swapped,
  coalesce({_dec(_AMOUNTS, 1)} + {_dec(_AMOUNTS, 2)} <> {_dec(_AMOUNTS, 3)}, false) AS amounts,
  CAST({_dec(_LENGTH, 2)} * {_dec(_LENGTH, 3)} * 100 AS DOUBLE) / nullif(CAST({_dec(_LENGTH, 1)} * 12 AS DOUBLE), 0) AS v1,
  CAST({_dec(_RATIO, 3)} * {_dec(_RATIO, 1)} AS DOUBLE) / nullif(CAST({_dec(_RATIO, 1)} + {_dec(_RATIO, 2)} AS DOUBLE), 0) AS v2,
  CAST({_dec(_COVER, 3)} * {_dec(_COVER, 1)} AS DOUBLE) / nullif(CAST({_dec(_COVER, 2)} AS DOUBLE), 0) AS v3 FROM s),
 k AS (SELECT *, list_sort(list_filter([CASE WHEN rate THEN 'rate_unit_relation_corruption' END, CASE WHEN likely THEN 'comparison_polarity_or_sign' END, CASE WHEN likely THEN 'answer_normalization_abs_sign' END,
  CASE WHEN swapped THEN 'target_or_subquestion_drift' END, CASE WHEN amounts THEN 'condition_insertion_or_deletion' END, CASE WHEN amounts THEN 'implicit_default_assumption' END,
  CASE WHEN regexp_matches(q, '(?i)\\b(?:last|remaining)\\b.*\\b(?:last|remaining)\\b') THEN 'quantifier_scope_last_remaining' END, CASE WHEN regexp_matches(q, '(?i)\\b(?:unrelated|irrelevant)\\b') THEN 'distractor_operand_interference' END,
  CASE WHEN regexp_matches(q, '\\b\\d+(?:\\.\\d+)?\\s*=\\s*\\d+\\b|\\b(?:it|to|the)[a-z]{{8,}}\\b') THEN 'extraction_or_ocr_uncertain' END], lambda x: x IS NOT NULL)) AS tags,
  CASE WHEN NOT (rate OR likely OR swapped OR amounts) THEN regexp_replace(CAST(coalesce(v1, v2, v3) AS VARCHAR), '\\.0$', '') END AS v FROM g),
 e AS (SELECT *, CASE WHEN TRY_CAST(replace(trim(v), ',', '') AS DECIMAL(38, 18)) IS NOT NULL AND TRY_CAST(replace(trim(answer), ',', '') AS DECIMAL(38, 18)) IS NOT NULL
  THEN TRY_CAST(replace(trim(v), ',', '') AS DECIMAL(38, 18)) = TRY_CAST(replace(trim(answer), ',', '') AS DECIMAL(38, 18)) ELSE lower(replace(trim(v), ',', '')) = lower(replace(trim(answer), ',', '')) END AS same FROM k),
 a AS (SELECT *, CASE WHEN v IS NULL OR answer IS NULL THEN 'label_unverifiable' WHEN same AND v = answer THEN 'aligned' WHEN same THEN 'normalized_equivalent' ELSE 'semantic_conflict' END AS alignment FROM e),
 z AS (SELECT *, CASE WHEN alignment = 'semantic_conflict' THEN 'S4' WHEN rate OR likely OR swapped OR amounts THEN 'S3' WHEN len(tags) > 0 THEN 'S2' ELSE 'S0' END AS severity FROM a)"""


def _screened(spark, d):
    """(instance_id, answer, value, tags, alignment, severity) of all questions and the made ones."""
    t = inputs.tasks(spark, d).where("user_query IS NOT NULL").select("instance_id", "user_query").join(inputs.labels(spark, d).select("instance_id", "answer"), "instance_id", "left")
    made = spark.createDataFrame(_QUESTIONS, "instance_id string, user_query string, answer string")
    rows = t.unionByName(made).withColumn("q", F.trim(F.regexp_replace("user_query", r"\s+", " "))).withColumn("tags", S.tags(F.col("q")))
    # Only a question with one explicit reading has a computed answer.
    clear = ~F.arrays_overlap("tags", F.array(*[F.lit(x) for x in S.GRAVE]))
    rows = rows.withColumn("value", F.when(clear, F.regexp_replace(S.computed_answer(F.col("q"))[1].cast("string"), r"\.0$", "")))
    told = F.when(F.col("answer").isNull(), "label_unverifiable").otherwise(M.alignment(F.col("value"), F.col("answer")))
    rows = rows.withColumn("alignment", told)
    return rows.withColumn("severity", S.severity(F.col("tags"), F.col("alignment") == "semantic_conflict"))


@query(sql(f"t q|{_SCREENED}", "SELECT instance_id, answer, v AS value, array_to_string(tags, ',') AS tags, alignment, severity FROM z"))
def alignment_severity(spark, d):
    """The screen's tags, computed answer, alignment with the label and severity of every question."""
    return _screened(spark, d).select("instance_id", "answer", "value", F.array_join("tags", ",").alias("tags"), "alignment", "severity")


_OVERLAY = f"""rv AS (SELECT instance_id, CASE f WHEN '0' THEN 'S0' WHEN '1' THEN 'S3' WHEN '2' THEN 'S1' END AS severity, CASE f WHEN '0' THEN ['clean'] WHEN '1' THEN ['rate_unit_relation_corruption'] WHEN '3' THEN ['distractor_operand_interference', 'extraction_or_ocr_uncertain'] END AS tags,
  CASE f WHEN '0' THEN 'aligned' WHEN '2' THEN 'semantic_conflict' WHEN '3' THEN 'unheard_of' END AS alignment, CASE f WHEN '0' THEN '20' WHEN '2' THEN '999' END AS value
  FROM (SELECT DISTINCT instance_id, substr(sha256('review:' || instance_id), 1, 1) AS f FROM z) WHERE f IN ('0', '1', '2', '3')),
 j AS (SELECT z.instance_id, z.answer, z.alignment AS auto, rv.instance_id IS NOT NULL AS reviewed, coalesce(rv.severity, z.severity) AS grade, z.tags, coalesce(rv.tags, z.tags) AS own, rv.alignment AS claimed, rv.value FROM z LEFT JOIN rv USING (instance_id)),
 j2 AS (SELECT *, CASE WHEN NOT reviewed THEN tags WHEN grade = 'S0' THEN own ELSE list_distinct(list_concat(tags, own)) END AS u,
  value IS NOT NULL AND answer IS NOT NULL AND CASE WHEN TRY_CAST(replace(trim(answer), ',', '') AS DECIMAL(38, 18)) IS NOT NULL THEN TRY_CAST(value AS DECIMAL(38, 18)) = TRY_CAST(replace(trim(answer), ',', '') AS DECIMAL(38, 18)) ELSE value = lower(replace(trim(answer), ',', '')) END AS same FROM j)"""


@query(sql(f"t q|{_SCREENED}, {_OVERLAY}", """SELECT instance_id, grade AS severity, array_to_string(list_sort(CASE WHEN grade <> 'S0' OR len(u) > 1 THEN list_filter(u, lambda x: x <> 'clean') WHEN len(u) = 0 THEN ['clean'] ELSE u END), ',') AS tags,
 CASE WHEN claimed IN ('aligned', 'normalized_equivalent', 'semantic_conflict', 'label_unverifiable') THEN claimed ELSE auto END AS alignment,
 CASE grade WHEN 'S0' THEN 'none' WHEN 'S1' THEN 'low' WHEN 'S2' THEN 'medium' ELSE 'high' END AS risk,
 coalesce(value IS NOT NULL AND claimed IN ('aligned', 'normalized_equivalent', 'semantic_conflict') AND claimed <> CASE WHEN same AND value = answer THEN 'aligned' WHEN same THEN 'normalized_equivalent' ELSE 'semantic_conflict' END, false) AS disagrees FROM j2"""))
def review_overlay(spark, d):
    """The screen with reviews over it: a quarter of the questions has one, some of which contradict themselves."""
    rows = _screened(spark, d).select("instance_id", "severity", "tags", "alignment", "answer")
    f = F.substring(F.sha2(F.concat(F.lit("review:"), F.col("instance_id")), 256), 1, 1)
    ids = rows.select("instance_id").distinct().withColumn("f", f).where("f IN ('0', '1', '2', '3')")
    pick = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k[1:]), F.lit(v))])[F.col("f")]
    tags = F.when(F.col("f") == "0", F.array(F.lit("clean"))).when(F.col("f") == "1", F.array(F.lit("rate_unit_corruption"))).when(F.col("f") == "3", F.array(F.lit("distractor"), F.lit("ocr_uncertainty")))
    reviews = ids.select("instance_id", pick(_0="S0", _1="S3", _2="S1").alias("severity"), tags.alias("tags"), pick(_0="aligned", _2="semantic_conflict", _3="unheard_of").alias("alignment"), pick(_0="20", _2="999").alias("value"))
    return M.overlaid(rows, reviews).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH v AS (SELECT unnest(map_entries({_ALIAS})) AS e) SELECT e.key AS tag, e.value AS resolved FROM v UNION ALL SELECT e.value, e.value FROM v UNION ALL SELECT 'clean', 'clean'""")
def tag_alias(spark, d):
    """Every short name of a tag with what it stands for; full names stand for themselves."""
    rows = [(k,) for k in [*M.TAG_ALIASES, *M.TAG_ALIASES.values(), "clean"]]
    return spark.createDataFrame(rows, "tag string").select("tag", M.resolved(F.array("tag"))[0].alias("resolved"))


# --- composite scores -----------------------------------------------------------------------------------------------------

_TEXTS = r"""x AS (SELECT id, string_agg(f, chr(10) ORDER BY block_id, f) AS a, list(block_id ORDER BY block_id, f) AS xs FROM (SELECT id, block_id, regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '[ \t]+', ' ', 'g') AS f FROM ra WHERE block_id IS NOT NULL) GROUP BY 1),
 y AS (SELECT id, string_agg(f, chr(10) ORDER BY block_id, f) AS b, list(block_id ORDER BY block_id, f) AS ys FROM (SELECT id, block_id, regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '[ \t]+', ' ', 'g') AS f FROM pa WHERE block_id IS NOT NULL) GROUP BY 1),
 s AS (SELECT id, a, b, levenshtein(a, b) AS d, length(a) AS n, length(b) AS m, len(list_intersect(list_distinct(xs), list_distinct(ys))) AS hits, len(list_distinct(xs)) AS nx, len(list_distinct(ys)) AS ny, xs = ys AS ordered_exact FROM x JOIN y USING (id)),
 i AS (SELECT id, a = b AS exact, CAST(n AS BIGINT) AS reference_chars, CAST(m AS BIGINT) AS seen_chars, CAST(d AS BIGINT) AS distance, CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 0.0 ELSE 1.0 END ELSE d / n END AS cer,
  CASE WHEN greatest(n, m) = 0 THEN 1.0 ELSE 1.0 - d / greatest(n, m) END AS similarity, CASE WHEN nx + ny = 0 THEN 1.0 ELSE 2.0 * hits / (nx + ny) END AS block_f1, ordered_exact FROM s)"""


def _documents(spark, d):
    """(id, a, b, xs, ys): the whole text and block ids of documents two engines have read; characters beyond ASCII count as one class."""
    def side(rows, text, ids):
        f = T.strict_text(F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
        blocks = rows.where("block_id IS NOT NULL").select("id", "block_id", f.alias("f"))
        pairs = F.array_sort(F.collect_list(F.struct("block_id", "f")))
        return blocks.groupBy("id").agg(pairs.alias("p")).select("id", F.array_join(F.transform("p", lambda x: x["f"]), "\n").alias(text), F.transform("p", lambda x: x["block_id"]).alias(ids))

    a, b = inputs.engine_pairs(spark, d)
    return side(a, "a", "xs").join(side(b, "b", "ys"), "id")


@query(sql(f"b ends ra pa|{_TEXTS}", "SELECT id, exact, reference_chars, seen_chars, distance, round(cer, 6) AS cer, round(greatest(0.0, 1.0 - cer), 6) AS accuracy, round(similarity, 6) AS similarity, round(block_f1, 6) AS block_f1, ordered_exact FROM i"))
def score_instances(spark, d):
    """The composite score of every document two engines have read."""
    scored = E.instance_scores(_documents(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return scored.select("id", "exact", "reference_chars", "seen_chars", "distance", r("cer"), r("accuracy"), r("similarity"), r("block_f1"), "ordered_exact")


@query(sql(f"b ends ra pa|{_TEXTS}", """SELECT count(*) AS instances, count(*) FILTER (exact) AS exact_count, round(avg(cer), 6) AS macro_cer, round(sum(distance) / sum(reference_chars), 6) AS micro_cer,
 round(100.0 * greatest(0.0, 1.0 - sum(distance) / sum(reference_chars)), 6) AS text_score, round(avg(similarity), 6) AS macro_similarity, round(avg(block_f1), 6) AS mean_block_f1,
 count(*) FILTER (ordered_exact) AS ordered_exact_count, round(count(*) FILTER (ordered_exact) / count(*), 6) AS ordered_exact_rate FROM i"""))
def scorecard(spark, d):
    """One line of the composite scores of all documents."""
    out = E.scorecard(E.instance_scores(_documents(spark, d)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


QUERIES, SQL = query.queries, query.sql
