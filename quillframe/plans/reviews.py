"""Contracts of reviews, questions, references and runs; recovered queries and tagged outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import evaluate as E
from quillframe.operators import review as R
from quillframe.operators import rules
from quillframe.operators import screen as S
from quillframe.plans import inputs
from quillframe.plans.inputs import sql
from quillframe.plans.registry import Registry
from quillframe.plans.validation import _cases
from quillframe.session import table

query = Registry()
_ID = "regexp_full_match(x, 'b[0-9]{2}')"
_WORD_LEVELS = "'high', 'medium', 'low'"


@query(sql("q|v AS (SELECT instance_id, 'run-' || right(instance_id, 1) || CASE WHEN ascii(right(instance_id, 1)) % 3 = 0 THEN '-0001' ELSE '' END AS run_id, answer, evidence, ascii(right(instance_id, 1)) % 4 <> 1 AS unique_answer, CASE ascii(right(instance_id, 1)) % 4 WHEN 0 THEN 'high' WHEN 1 THEN '0.5' WHEN 2 THEN '1.5' END AS confidence FROM q)",
    _cases([
        ("bad_run_id", "coalesce(NOT length(run_id) BETWEEN 8 AND 128, true)"),
        ("bad_answer", "unique_answer AND coalesce(NOT regexp_full_match(answer, '\\S+'), true)"),
        ("answer_without_uniqueness", "NOT unique_answer AND answer IS NOT NULL"),
        ("bad_evidence", f"coalesce(len(list_filter(evidence, lambda x: coalesce(NOT {_ID}, true))) > 0 OR len(list_distinct(evidence)) < len(evidence), true)"),
        ("bad_confidence", f"coalesce(confidence NOT IN ({_WORD_LEVELS}) AND coalesce(NOT TRY_CAST(confidence AS DOUBLE) BETWEEN 0 AND 1, true), true)"),
    ], "instance_id", "v")))
def review_violations(spark, d):
    """Review rows made from the labels: some run ids are short, some confidences out of range or missing."""
    last = F.ascii(F.right("instance_id", F.lit(1)))
    run = F.concat(F.lit("run-"), F.right("instance_id", F.lit(1)), F.when(last % 3 == 0, "-0001").otherwise(""))
    level = F.when(last % 4 == 0, "high").when(last % 4 == 1, "0.5").when(last % 4 == 2, "1.5")
    rows = inputs.labels(spark, d).select("instance_id", run.alias("run_id"), "answer", "evidence", (last % 4 != 1).alias("unique_answer"), level.alias("confidence"))
    return rules.violations(rows, ["instance_id"], R.review_rules())


@query(sql("b rec|g AS (SELECT instance_id, engine, list(block_id ORDER BY block_id) AS ids, count(CASE WHEN trim(text) = '' OR text IS NULL THEN 1 END) AS n_empty FROM (SELECT instance_id, engine, block_id, min(text) AS text FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2), v AS (SELECT g.*, rec.status FROM g LEFT JOIN rec ON g.instance_id = rec.instance_id AND g.engine = rec.engine)",
    _cases([
        ("ids_not_consecutive", "ids <> list_transform(range(1, len(ids) + 1), lambda x: printf('b%02d', x))"),
        ("empty_text", "n_empty > 0"), ("not_ok", "coalesce(status <> 'ok', true)"),
    ], "instance_id, engine", "v")))
def silver_reference_checks(spark, d):
    one = inputs.blocks(spark, d).groupBy("instance_id", "engine", "block_id").agg(F.min("text").alias("text"))
    empty = F.count(F.when(F.col("text").isNull() | (F.trim("text") == ""), 1))
    g = one.groupBy("instance_id", "engine").agg(F.array_sort(F.collect_list("block_id")).alias("ids"), empty.alias("n_empty"))
    rows = g.join(inputs.records(spark, d).select("instance_id", "engine", "status"), ["instance_id", "engine"], "left")
    return rules.violations(rows, ["instance_id", "engine"], R.reference_rules())


@query()
def audit_violations(spark, d):
    """Audit records built by the screen, checked against their own contract: a correct screen gives no row."""
    t = inputs.tasks(spark, d).where("user_query IS NOT NULL").select("instance_id", S.tags(F.col("user_query")).alias("tags"))
    j = t.join(inputs.labels(spark, d).select("instance_id", "answer"), "instance_id", "left")
    alignment = F.when(F.col("answer").isNull(), "label_unverifiable").otherwise("aligned")
    rows = j.select("instance_id", "tags", alignment.alias("alignment"), S.severity(F.col("tags"), F.lit(False)).alias("severity"))
    return rules.violations(rows, ["instance_id"], R.audit_rules())


@query(sql("rec|s AS (SELECT engine, ascii(right(instance_id, 1)) % 4 AS shard, status FROM rec), v AS (SELECT engine, shard, count(*) AS n, count(CASE WHEN status = 'failed' THEN 1 END) AS n_failed, count(*) + CASE WHEN shard = 3 THEN 1 ELSE 0 END AS declared, count(CASE WHEN status = 'failed' THEN 1 END) AS declared_failed, 3 AS n_shards FROM s GROUP BY 1, 2)",
    _cases([("count_differs", "declared <> n"), ("failed_differs", "declared_failed <> n_failed"), ("bad_shard", "NOT shard BETWEEN 0 AND n_shards - 1")], "engine, shard", "v")))
def runtime_violations(spark, d):
    """Shard reports against their records; the last shard's report is made wrong on purpose."""
    shard = F.ascii(F.right("instance_id", F.lit(1))) % 4
    failed = F.count(F.when(F.col("status") == "failed", 1))
    g = inputs.records(spark, d).groupBy("engine", shard.alias("shard")).agg(F.count("*").alias("n"), failed.alias("n_failed"))
    rows = g.withColumn("declared", F.col("n") + F.when(F.col("shard") == 3, 1).otherwise(0)).withColumn("declared_failed", F.col("n_failed")).withColumn("n_shards", F.lit(3))
    return rules.violations(rows, ["engine", "shard"], R.run_rules())


@query(sql("b|h AS (SELECT instance_id, engine, block_id, unnest(string_split_regex(text, '(?i)is\\s+set\\s+aside\\s+for')[2:]) AS q FROM b WHERE text IS NOT NULL), g AS (SELECT instance_id, engine, count(*) AS n, min(block_id) AS block_id, min(trim(q, ' ')) AS q FROM h WHERE trim(q, ' ') <> '' GROUP BY 1, 2)",
    "SELECT k.instance_id, k.engine, CASE WHEN n IS NULL THEN 'no_match' WHEN n > 1 THEN 'several_matches' ELSE 'recovered' END AS status, CASE WHEN n = 1 THEN block_id END AS block_id, CASE WHEN n = 1 THEN q END AS query FROM (SELECT DISTINCT instance_id, engine FROM b) k LEFT JOIN g ON k.instance_id = g.instance_id AND k.engine = g.engine"))
def query_recovery(spark, d):
    return R.recovered_queries(inputs.blocks(spark, d), ["instance_id", "engine"], ["is set aside for"])


@query()
def html_blocks(spark, d):
    return R.html_blocks(inputs.results(spark, d).where("raw_output IS NOT NULL"), ["instance_id", "model_index"], "raw_output")


@query(sql("b ends ra pa|x AS (SELECT id, list(block_id ORDER BY block_id) AS xs FROM (SELECT DISTINCT id, block_id FROM ra WHERE block_id IS NOT NULL) GROUP BY 1), y AS (SELECT id, list(block_id ORDER BY block_id DESC) AS ys FROM (SELECT DISTINCT id, block_id FROM pa WHERE block_id IS NOT NULL) GROUP BY 1)",
    "SELECT id, xs = ys AS ordered_exact, xs <> ys AND list_sort(xs) = list_sort(ys) AS reordered FROM x JOIN y USING (id)"))
def ordered_flags(spark, d):
    """Ids of one engine against those of another, read backwards."""
    a, b = (s.where("block_id IS NOT NULL").select("id", "block_id").distinct().groupBy("id").agg(F.array_sort(F.collect_list("block_id")).alias("x")) for s in inputs.engine_pairs(spark, d))
    joined = a.withColumnRenamed("x", "xs").join(b.select("id", F.reverse("x").alias("ys")), "id")
    s = E.agreement(F.col("xs"), F.col("ys"))
    return joined.select("id", s["ordered_exact"].alias("ordered_exact"), s["reordered"].alias("reordered"))


@query(sql("b ends ra pa|s AS (SELECT ra.id, ra.block_id, regexp_replace(ra.text, '[^\\x00-\\x7F]', '?', 'g') AS x, regexp_replace(pa.text, '[^\\x00-\\x7F]', '?', 'g') AS y FROM ra JOIN pa ON ra.id = pa.id AND ra.block_id = pa.block_id)",
    "SELECT id, block_id, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS similarity FROM s"))
def edit_similarity_pairs(spark, d):
    """Similarity of the blocks of two engines; characters beyond ASCII count as one class."""
    a, b = inputs.engine_pairs(spark, d)
    fold = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    j = a.select("id", "block_id", fold("text").alias("x")).join(b.select("id", "block_id", fold("text").alias("y")), ["id", "block_id"])
    return j.select("id", "block_id", F.round(T.similarity(T.char_distance(F.col("x"), F.col("y")), F.length("x"), F.length("y")), 6).alias("similarity"))


@query(sql("t", """SELECT instance_id, CAST(length(user_query) AS BIGINT) AS n_chars, CAST(len(list_filter(string_split_regex(user_query, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words,
 CAST(len(regexp_extract_all(user_query, '\\d+')) AS BIGINT) AS n_numbers FROM t WHERE user_query IS NOT NULL"""))
def task_features(spark, d):
    words = F.filter(F.split("user_query", r"\s+"), lambda w: w != "")
    return inputs.tasks(spark, d).where("user_query IS NOT NULL").select("instance_id", F.length("user_query").cast("long").alias("n_chars"), F.size(words).cast("long").alias("n_words"), F.size(F.regexp_extract_all("user_query", F.lit(r"(\d+)"), 1)).cast("long").alias("n_numbers"))


@query(sql("q", "SELECT instance_id, array_to_string(list_filter(list_transform(evidence, lambda x, i: CASE WHEN list_position(evidence, x) = i THEN x END), lambda x: x IS NOT NULL), ',') AS evidence FROM q WHERE evidence IS NOT NULL"))
def evidence_in_order(spark, d):
    """Evidence without repeats, the first occurrence kept in place."""
    return inputs.labels(spark, d).where("evidence IS NOT NULL").select("instance_id", F.array_join(F.array_distinct("evidence"), ",").alias("evidence"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(min(n_chars) AS BIGINT) AS least, CAST(max(n_chars) AS BIGINT) AS most, round(avg(n_chars), 4) AS mean, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS middle FROM documents GROUP BY 1""")
def describe_documents(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("middle"))

@query(sql("t rec|v AS (SELECT t.instance_id, rec.engine, t.user_query AS question_text, document_pdf AS pdf_path, pages, substr(sha256('field:' || t.instance_id), 1, 1) AS f FROM t JOIN rec USING (instance_id))",
    _cases([
        ("no_question", "coalesce(trim(question_text) = '', true)"),
        ("unsafe_path", "pdf_path = '' OR regexp_matches(pdf_path, '^(/|\\\\|[A-Za-z]:)') OR regexp_matches(pdf_path, '(^|[/\\\\])\\.\\.([/\\\\]|$)') OR pdf_path IS NULL"),
        ("no_pages", "coalesce(len(pages) < 1, true)"), ("label_field", "f IN ('0', '1')"),
    ], "instance_id, engine", "v")))
def blind_question_violations(spark, d):
    """Blind questions with the names of their further fields, some of which give the label away."""
    t = inputs.tasks(spark, d).select("instance_id", F.col("user_query").alias("question_text"), F.col("document_pdf").alias("pdf_path"))
    f = F.substring(F.sha2(F.concat(F.lit("field:"), F.col("instance_id")), 256), 1, 1)
    extra = F.when(f == "0", F.array(F.lit("answer"))).when(f == "1", F.array(F.lit("note"), F.lit("Evidence"))).when(f == "2", F.array(F.lit("note"))).otherwise(F.array())
    rows = t.join(inputs.records(spark, d).select("instance_id", "engine", "pages"), "instance_id").withColumn("fields", extra.cast("array<string>"))
    return rules.violations(rows, ["instance_id", "engine"], R.question_rules(R.gives_label_away(F.col("fields"))))


@query(sql("t|c AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - row_number() OVER (ORDER BY instance_id, user_query), user_query FROM (SELECT DISTINCT instance_id, user_query FROM t WHERE substr(sha256('leak:' || instance_id), 1, 1) = '0' AND user_query IS NOT NULL))",
    "SELECT t.instance_id, count(*) AS n_texts FROM t JOIN c ON c.text = t.user_query GROUP BY 1"))
def leak_gate(spark, d):
    """Task queries that are a whole text of the training corpus, to which every sixteenth query is added; texts meet by hash."""
    t = inputs.tasks(spark, d).where("user_query IS NOT NULL").select("instance_id", "user_query")
    planted = t.where(F.substring(F.sha2(F.concat(F.lit("leak:"), F.col("instance_id")), 256), 1, 1) == "0").distinct().select(F.col("user_query").alias("text"))
    corpus = table(spark, d, "documents").select("text").where("text IS NOT NULL").unionByName(planted)
    key = lambda c: (F.xxhash64(c).alias("h"), F.length(c).alias("n"))
    # Only keys are shuffled widely: texts travel where a query has the same hash and length.
    wanted = t.select(*key("user_query")).distinct()
    hits = corpus.select("text", *key("text")).join(wanted, ["h", "n"], "left_semi")
    joined = t.select("instance_id", "user_query", *key("user_query")).join(hits, ["h", "n"])
    return joined.where(F.col("user_query") == F.col("text")).groupBy("instance_id").agg(F.count("*").alias("n_texts"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY instance_id, engine, block_id ORDER BY received_at NULLS LAST, text) AS i, count(*) OVER (PARTITION BY instance_id, engine, block_id) AS n FROM ocr_blocks WHERE text IS NOT NULL AND block_id IS NOT NULL)
 SELECT instance_id, engine, block_id, text, n FROM k WHERE i = 1""")
def dedupe_keep_first(spark, d):
    """The first arrival of every block, without sorting: one ordered minimum per group."""
    b = table(spark, d, "ocr_blocks").where("text IS NOT NULL AND block_id IS NOT NULL")
    late = F.col("received_at").isNull()
    first = F.min_by("text", F.struct(late.alias("late"), "received_at", "text"))
    return b.groupBy("instance_id", "engine", "block_id").agg(first.alias("text"), F.count("*").alias("n"))



QUERIES, SQL = query.queries, query.sql
