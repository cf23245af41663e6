"""Scans, joins, set operations, aggregates and order-dependent reports over the stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import hashing
from quillframe.operators import rules
from quillframe.plans import inputs
from quillframe.plans.inputs import sql
from quillframe.plans.registry import Registry
from quillframe.session import table

query = Registry()


def _long(c):
    return c.cast("long")


@query(sql("t", """SELECT instance_id, user_query, document_pdf, sha256(coalesce(user_query, '')) AS query_sha,
 CAST(length(user_query) AS BIGINT) AS n_chars FROM t"""))
def task_projection(spark, d):
    t = inputs.tasks(spark, d)
    return t.select("instance_id", "user_query", "document_pdf", F.sha2(F.coalesce("user_query", F.lit("")), 256).alias("query_sha"), _long(F.length("user_query")).alias("n_chars"))


@query("SELECT instance_id, count(*) AS n FROM tasks GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark, d):
    return rules.duplicates(table(spark, d, "tasks"), ["instance_id"])


@query(sql("t q", """SELECT instance_id, 'missing' AS problem FROM (SELECT instance_id FROM t EXCEPT SELECT instance_id FROM q)
 UNION ALL SELECT instance_id, 'extra' FROM (SELECT instance_id FROM q EXCEPT SELECT instance_id FROM t)"""))
def coverage_missing_extra(spark, d):
    return rules.coverage(inputs.tasks(spark, d), inputs.labels(spark, d), "instance_id")


@query(sql("t q", """SELECT t.instance_id, split, answer, CAST(len(evidence) AS BIGINT) AS n_evidence, CAST(length(user_query) AS BIGINT) AS n_chars
 FROM t JOIN q USING (instance_id)"""))
def label_join_one_to_one(spark, d):
    joined = inputs.tasks(spark, d).join(inputs.labels(spark, d), "instance_id")
    return joined.select("instance_id", "split", "answer", F.when(F.col("evidence").isNotNull(), _long(F.size("evidence"))).alias("n_evidence"), _long(F.length("user_query")).alias("n_chars"))


@query(sql("b ends ra pa", """SELECT coalesce(ra.id, pa.id) AS id, count(*) AS n_union, count(ra.text) AS n_reference, count(pa.text) AS n_seen,
 CAST(count(CASE WHEN ra.text = pa.text THEN 1 END) AS BIGINT) AS n_equal
 FROM ra FULL OUTER JOIN pa ON ra.id = pa.id AND ra.block_id = pa.block_id GROUP BY 1"""))
def full_outer_status(spark, d):
    from quillframe.operators.evaluate import compared

    joined = compared(*inputs.engine_pairs(spark, d))
    return joined.groupBy("id").agg(F.count("*").alias("n_union"), F.count("reference").alias("n_reference"), F.count("seen").alias("n_seen"), F.count(F.when(F.col("reference") == F.col("seen"), 1)).alias("n_equal"))


@query(sql("t q", "SELECT instance_id, user_query, document_pdf FROM t WHERE instance_id IN (SELECT instance_id FROM q)"))
def subset_semi(spark, d):
    return inputs.tasks(spark, d).select("instance_id", "user_query", "document_pdf").join(inputs.labels(spark, d).select("instance_id"), "instance_id", "left_semi")


@query(sql("t", """SELECT DISTINCT a.user_query FROM t a WHERE split = 'train' AND user_query IN
 (SELECT user_query FROM t WHERE split IN ('val', 'validation', 'test'))"""))
def split_disjoint(spark, d):
    t = inputs.tasks(spark, d).select("split", "user_query")
    held = t.where("split IN ('val', 'validation', 'test')").select("user_query")
    return t.where("split = 'train'").select("user_query").join(held, "user_query", "left_semi").distinct()


@query(sql("t q rec r", """SELECT t.instance_id, rec.engine, r.name, r.model_index AS model_index, answer, rec.status AS ocr_status, r.status AS result_status
 FROM t JOIN rec USING (instance_id) JOIN q USING (instance_id) JOIN r USING (instance_id)
 WHERE rec.user_query = t.user_query"""))
def nway_audit(spark, d):
    t = inputs.tasks(spark, d).select("instance_id", "user_query")
    rec = inputs.records(spark, d).select("instance_id", F.col("user_query").alias("seen_query"), "engine", F.col("status").alias("ocr_status"))
    r = inputs.results(spark, d).select("instance_id", "name", "model_index", F.col("status").alias("result_status"))
    joined = t.join(rec, "instance_id").join(inputs.labels(spark, d), "instance_id").join(r, "instance_id").where("seen_query = user_query")
    return joined.select("instance_id", "engine", "name", "model_index", "answer", "ocr_status", "result_status")


@query(sql("t rec", """SELECT engine, count(*) AS n, count(CASE WHEN t.user_query = rec.user_query THEN 1 END) AS n_raw_equal,
 count(CASE WHEN trim(regexp_replace(t.user_query, '\\s+', ' ', 'g')) = trim(regexp_replace(rec.user_query, '\\s+', ' ', 'g')) THEN 1 END) AS n_blank_equal,
 count(CASE WHEN sha256(t.user_query) = sha256(rec.user_query) THEN 1 END) AS n_sha_equal
 FROM t JOIN rec USING (instance_id) GROUP BY 1"""))
def pass_through_equality(spark, d):
    t = inputs.tasks(spark, d).select("instance_id", F.col("user_query").alias("a"))
    rec = inputs.records(spark, d).select("instance_id", "engine", F.col("user_query").alias("b"))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    hits = lambda c: F.count(F.when(c, 1))
    return t.join(rec, "instance_id").groupBy("engine").agg(F.count("*").alias("n"), hits(F.col("a") == F.col("b")).alias("n_raw_equal"), hits(flat("a") == flat("b")).alias("n_blank_equal"), hits(F.sha2("a", 256) == F.sha2("b", 256)).alias("n_sha_equal"))


@query(sql("r", """SELECT r.name, model_index, repo, element AS short_name, count(*) AS n, bool_and(r.name = element) AS names_agree
 FROM (SELECT *, string_split(repo, '/')[-1] AS element FROM r) r GROUP BY ALL"""))
def model_membership(spark, d):
    r = inputs.results(spark, d).withColumn("short_name", F.element_at(F.split("repo", "/"), -1))
    return r.groupBy("name", "model_index", "repo", "short_name").agg(F.count("*").alias("n"), F.bool_and(F.col("name") == F.col("short_name")).alias("names_agree"))


@query("SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def pairs_theta(spark, d):
    r = table(spark, d, "region")
    a, b = r.select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("left_name")), r.select(F.col("r_regionkey").alias("j"), F.col("r_name").alias("right_name"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("left_name", "right_name")


@query(sql("rec", "SELECT engine, coalesce(status, 'none') AS status, coalesce(error_kind, 'none') AS error_kind, count(*) AS n FROM rec GROUP BY 1, 2, 3"))
def nested_counts(spark, d):
    none = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    return inputs.records(spark, d).groupBy("engine", none("status"), none("error_kind")).agg(F.count("*").alias("n"))


@query(sql("q", "SELECT block_id, count(*) AS n FROM (SELECT unnest(evidence) AS block_id FROM q) GROUP BY 1"))
def evidence_counts(spark, d):
    return inputs.labels(spark, d).select(F.explode("evidence").alias("block_id")).groupBy("block_id").agg(F.count("*").alias("n"))


@query(sql("rec", """SELECT engine, count(s) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(quantile_disc(s, 0.95), 6) AS p95,
 round(max(s), 6) AS most, round(60.0 / avg(s), 6) AS per_minute FROM (SELECT engine, timing['total_seconds'] AS s FROM rec WHERE status = 'ok') GROUP BY 1"""))
def latency_summary(spark, d):
    from quillframe.operators.evaluate import latency

    rows = inputs.records(spark, d).where("status = 'ok'").select("engine", F.col("timing")["total_seconds"].alias("s"))
    out = latency(rows, ["engine"], "s")
    return out.select("engine", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "most", "per_minute")])


@query(sql("r", """SELECT coalesce(name, 'all') AS name, coalesce(status, 'all') AS status, count(*) AS n,
 count(CASE WHEN truncation_risk THEN 1 END) AS n_at_risk FROM r WHERE name IS NOT NULL AND status IS NOT NULL GROUP BY GROUPING SETS ((), (name), (name, status))"""))
def status_rollup(spark, d):
    r = inputs.results(spark, d).where("name IS NOT NULL AND status IS NOT NULL")
    out = r.rollup("name", "status").agg(F.count("*").alias("n"), F.count(F.when(F.col("truncation_risk"), 1)).alias("n_at_risk"))
    return out.select(F.coalesce("name", F.lit("all")).alias("name"), F.coalesce("status", F.lit("all")).alias("status"), "n", "n_at_risk")


@query(sql("r", """SELECT name, CAST(count(DISTINCT max_new_tokens) AS BIGINT) AS n_limits, string_agg(DISTINCT status, '+' ORDER BY status) AS states FROM r GROUP BY 1"""))
def distinct_labels(spark, d):
    return inputs.results(spark, d).groupBy("name").agg(F.countDistinct("max_new_tokens").alias("n_limits"), F.array_join(F.array_sort(F.collect_set("status")), "+").alias("states"))


@query("""SELECT event_type, max(value) AS most, round(sum(coalesce(value, 0)), 4) AS total, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def peak_and_totals(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("most"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"), F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query(sql("q", """SELECT CAST(floor(v / 100) AS BIGINT) AS bin, count(*) AS n FROM (SELECT TRY_CAST(replace(trim(answer), ',', '') AS DOUBLE) AS v FROM q) WHERE v IS NOT NULL GROUP BY 1"""))
def histogram_answers(spark, d):
    v = F.replace(F.trim("answer"), F.lit(","), F.lit("")).try_cast("double")
    return inputs.labels(spark, d).select(v.alias("v")).where("v IS NOT NULL").groupBy(_long(F.floor(F.col("v") / 100)).alias("bin")).agg(F.count("*").alias("n"))


@query(sql("b", "SELECT text, count(*) AS n FROM b WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, text LIMIT 20"))
def top_texts(spark, d):
    """The 20 most frequent block texts (a top-k report)."""
    return inputs.blocks(spark, d).where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(20)


@query(sql("t", """SELECT instance_id, CASE WHEN lower(f) IN ('val', 'validation') THEN 'validation' WHEN lower(f) IN ('train', 'test') THEN lower(f) END AS split_name
 FROM (SELECT instance_id, coalesce(split, list_filter(string_split(replace(document_pdf, '\\', '/'), '/'), lambda x: x NOT IN ('', '.'))[1]) AS f FROM t)"""))
def split_infer(spark, d):
    folder = F.get(F.filter(F.split(F.translate("document_pdf", "\\", "/"), "/"), lambda x: ~x.isin("", ".")), 0)
    f = F.lower(F.coalesce("split", folder))
    return inputs.tasks(spark, d).select("instance_id", F.when(f.isin("val", "validation"), "validation").when(f.isin("train", "test"), f).alias("split_name"))


@query(sql("b ends ra pa", "SELECT id, block_id FROM ra UNION SELECT id, block_id FROM pa"))
def key_union(spark, d):
    a, b = inputs.engine_pairs(spark, d)
    return a.select("id", "block_id").unionByName(b.select("id", "block_id")).distinct()


@query(sql("t rec", """SELECT instance_id, 'no_record' AS problem FROM (SELECT instance_id FROM t EXCEPT SELECT instance_id FROM rec)
 UNION ALL SELECT instance_id, 'no_task' FROM (SELECT instance_id FROM rec EXCEPT SELECT instance_id FROM t)"""))
def set_differences(spark, d):
    a, b = inputs.tasks(spark, d).select("instance_id"), inputs.records(spark, d).select("instance_id")
    return a.subtract(b).withColumn("problem", F.lit("no_record")).unionByName(b.subtract(a).withColumn("problem", F.lit("no_task")))


@query(sql("q", """SELECT a.instance_id, list_sort(list_distinct(a.evidence)) = list_sort(list_distinct(b.blocks)) AS same_set, CAST(len(list_intersect(a.evidence, b.blocks)) AS BIGINT) AS n_common
 FROM q a JOIN (SELECT instance_id, list(DISTINCT block_id) AS blocks FROM ocr_blocks WHERE block_id IS NOT NULL GROUP BY 1) b USING (instance_id)
 WHERE a.evidence IS NOT NULL"""))
def evidence_sets(spark, d):
    b = inputs.blocks(spark, d).where("block_id IS NOT NULL").groupBy("instance_id").agg(F.collect_set("block_id").alias("blocks"))
    joined = inputs.labels(spark, d).where("evidence IS NOT NULL").join(b, "instance_id")
    same = F.array_sort(F.array_distinct("evidence")) == F.array_sort("blocks")
    return joined.select("instance_id", same.alias("same_set"), _long(F.size(F.array_intersect("evidence", "blocks"))).alias("n_common"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def dedupe_keep_last(spark, d):
    from quillframe.operators.plan import latest

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return latest(o, ["o_custkey"], "at").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events""")
def value_steps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"))


@query("""SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events WHERE json_valid(props)""")
def json_props(spark, d):
    e = table(spark, d, "events").withColumn("v", F.try_parse_json("props")).where("v IS NOT NULL")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), _long(F.size(F.json_object_keys("props"))).alias("n_keys"))


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
 round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def orders_by_nation(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("v"))  # aggregate before the join
    joined = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("k").cast("long").alias("n_orders"), F.round(F.sum("v"), 2).alias("total"))


@query(sql("t", """SELECT instance_id, input_pdf_sha256, sha256('{"document_pdf":' || coalesce('"' || replace(replace(document_pdf, '\\', '\\\\'), '"', '\\"') || '"', 'null') ||
 ',"instance_id":"' || instance_id || '"}') AS content_sha FROM t"""))
def content_hash(spark, d):
    return inputs.tasks(spark, d).select("instance_id", "input_pdf_sha256", hashing.record_sha(["document_pdf", "instance_id"]).alias("content_sha"))


@query(sql("t", """SELECT sha256(string_agg(h, ',' ORDER BY p)) AS total_sha, CAST(sum(n) AS BIGINT) AS n_records FROM
 (SELECT substr(sha256(instance_id), 1, 3) AS p, sha256(string_agg(instance_id || ':' || input_pdf_sha256, ',' ORDER BY instance_id, input_pdf_sha256)) AS h, count(*) AS n
 FROM t WHERE input_pdf_sha256 IS NOT NULL GROUP BY 1)"""))
def aggregate_hash(spark, d):
    return hashing.total_sha(inputs.tasks(spark, d).where("input_pdf_sha256 IS NOT NULL"), "instance_id", "input_pdf_sha256")


@query(sql("l", """SELECT instance_id, engine, page_number, CAST(row_number() OVER (PARTITION BY instance_id, engine ORDER BY page_number, source_order, text NULLS FIRST, block_id NULLS FIRST, confidence NULLS FIRST) AS BIGINT) AS place, text FROM l"""))
def layout_sort(spark, d):
    first = lambda c: F.col(c).asc_nulls_first()
    w = Window.partitionBy("instance_id", "engine").orderBy("page_number", "source_order", first("text"), first("block_id"), first("confidence"))
    return inputs.lines(spark, d).select("instance_id", "engine", "page_number", _long(F.row_number().over(w)).alias("place"), "text")


QUERIES, SQL = query.queries, query.sql
