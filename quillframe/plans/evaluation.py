"""Text, block and quantity scores of predictions against references."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import quantity as Q
from quillframe.functions import text as T
from quillframe.operators import blocks as B
from quillframe.operators import evaluate as E
from quillframe.plans import inputs
from quillframe.plans.inputs import sql
from quillframe.plans.registry import Registry
from quillframe.session import table

query = Registry()
_R6 = lambda c: F.round(c, 6)


_FLAT = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), '[ \\t]+', ' ', 'g')"


@query(sql(f"b ends ra pa|x AS (SELECT id, block_id, {_FLAT} AS a FROM ra WHERE block_id IS NOT NULL), y AS (SELECT id, block_id, {_FLAT} AS b FROM pa WHERE block_id IS NOT NULL), j AS (SELECT coalesce(x.id, y.id) AS id, coalesce(a, '') AS a, coalesce(b, '') AS b FROM x FULL OUTER JOIN y ON x.id = y.id AND x.block_id = y.block_id), s AS (SELECT lo, hi, levenshtein(a, b) AS d, length(a) AS n FROM j JOIN ends ON ends.instance_id = j.id)",
    "SELECT lo AS reference, hi AS seen, CAST(sum(d) AS BIGINT) AS distance, CAST(sum(n) AS BIGINT) AS length, round(sum(d) / sum(n), 6) AS micro_cer, round(100.0 * greatest(0.0, 1 - sum(d) / sum(n)), 6) AS text_score FROM s GROUP BY 1, 2"))
def eval_micro_cer(spark, d):
    """Micro character error rate between two engines that read the same documents; a block one lacks counts as a whole.

    Characters beyond ASCII count as one class, so that any SQL engine can check the distances.
    """
    def fold(rows):
        return rows.where("block_id IS NOT NULL").withColumn("text", T.strict_text(F.regexp_replace("text", r"[^\x00-\x7F]", "?")))

    reference, seen = (fold(x) for x in inputs.engine_pairs(spark, d))
    engines = inputs.blocks(spark, d).where("text IS NOT NULL").groupBy(F.col("instance_id").alias("id")).agg(F.min("engine").alias("lo"), F.max("engine").alias("hi"))
    rows = E.compared(reference, seen).na.fill("", ["reference", "seen"])
    scored = rows.select("id", T.char_distance(F.col("reference"), F.col("seen")).alias("distance"), F.length("reference").alias("length"))
    out = E.micro_error(scored.join(engines, "id"), ["lo", "hi"])
    score = F.lit(100.0) * F.greatest(F.lit(0.0), 1 - F.col("error_rate"))
    return out.select(F.col("lo").alias("reference"), F.col("hi").alias("seen"), "distance", "length", _R6("error_rate").alias("micro_cer"), _R6(score).alias("text_score"))


_SUBMITTED = """g AS (SELECT DISTINCT instance_id, answer, list_sort(list_distinct(evidence)) AS evidence, substr(sha256('portal:' || instance_id), 1, 1) AS f FROM q WHERE answer IS NOT NULL),
 s AS (SELECT *, CASE f WHEN '0' THEN answer || '0' WHEN '1' THEN '  ' || answer ELSE answer END AS told, CASE f WHEN '2' THEN evidence[1:len(evidence) - 1] WHEN '3' THEN list_sort(list_append(evidence, 'b99')) WHEN '4' THEN [] ELSE evidence END AS shown FROM g WHERE evidence IS NOT NULL)"""


@query(sql(f"q|{_SUBMITTED}", """SELECT instance_id, answer, CAST(CASE WHEN TRY_CAST(replace(trim(told), ',', '') AS DECIMAL(38, 18)) IS NOT NULL AND TRY_CAST(replace(trim(answer), ',', '') AS DECIMAL(38, 18)) IS NOT NULL
 THEN TRY_CAST(replace(trim(told), ',', '') AS DECIMAL(38, 18)) = TRY_CAST(replace(trim(answer), ',', '') AS DECIMAL(38, 18)) ELSE lower(replace(trim(told), ',', '')) = lower(replace(trim(answer), ',', '')) END AS DOUBLE) AS answer_score,
 CAST(shown = evidence AS DOUBLE) AS evidence_exact, round(CASE WHEN len(shown) + len(evidence) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(shown, evidence)) / (len(shown) + len(evidence)) END, 6) AS evidence_f1 FROM s"""))
def portal_score(spark, d):
    """A submission against the labels: answers as numbers or text, evidence as sets. The submission is made from the
    labels, with answers changed or padded and evidence dropped, added or left out."""
    g = inputs.labels(spark, d).where("answer IS NOT NULL AND evidence IS NOT NULL").select("instance_id", "answer", F.array_sort(F.array_distinct("evidence")).alias("evidence")).distinct()
    f = F.substring(F.sha2(F.concat(F.lit("portal:"), F.col("instance_id")), 256), 1, 1)
    told = F.when(f == "0", F.concat("answer", F.lit("0"))).when(f == "1", F.concat(F.lit("  "), "answer")).otherwise(F.col("answer"))
    e = F.col("evidence")
    shown = F.when(f == "2", F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0)))).when(f == "3", F.array_sort(F.array_append(e, F.lit("b99")))).when(f == "4", F.array().cast("array<string>")).otherwise(e)
    return E.portal(g.withColumn("told", told).withColumn("shown", shown)).select("instance_id", "answer", "answer_score", "evidence_exact", _R6("evidence_f1").alias("evidence_f1"))


def _rebuilt_against_stored(spark, d):
    """(id, block_id, reference, seen): the text rebuilt from lines, and the text the engine stored."""
    doc = ["instance_id", "engine"]
    built = B.rebuilt_blocks(B.without_artifacts(inputs.lines(spark, d).where("text IS NOT NULL"), doc), doc)
    first = built.groupBy(*doc, "block_id").agg(F.min_by("text", "seq").alias("reference"))
    stored = inputs.blocks(spark, d).where("text IS NOT NULL").withColumnRenamed("text", "seen")
    return first.join(stored, [*doc, "block_id"])


@query()
def eval_word_rates(spark, d):
    """Micro word error rate and mean similarity of stored against rebuilt blocks, per engine."""
    rows = _rebuilt_against_stored(spark, d).select("engine", T.words(F.col("reference")).alias("a"), T.words(F.col("seen")).alias("b"))
    scored = rows.select("engine", T.word_distance(F.col("a"), F.col("b")).alias("distance"), F.size("a").alias("length"), F.size("b").alias("n"))
    same = T.similarity(F.col("distance"), F.col("length"), F.col("n"))
    return scored.groupBy("engine").agg(F.sum("distance").cast("long").alias("distance"), F.sum("length").cast("long").alias("length"), _R6(F.avg(same)).alias("similarity"))


_FOLD = "regexp_replace({}, '[^\\x00-\\x7F]', '?', 'g')"


@query(sql("b ends ra pa", f"""SELECT ra.id, ra.block_id, CAST(levenshtein({_FOLD.format('ra.text')}, {_FOLD.format('pa.text')}) AS BIGINT) AS distance, CAST(length(ra.text) AS BIGINT) AS n_reference,
 CAST(length(pa.text) AS BIGINT) AS n_seen FROM ra JOIN pa ON ra.id = pa.id AND ra.block_id = pa.block_id"""))
def block_edit_distance(spark, d):
    """Edit distance of the blocks of two engines; characters beyond ASCII count as one class."""
    a, b = inputs.engine_pairs(spark, d)
    joined = a.withColumnRenamed("text", "x").join(b.withColumnRenamed("text", "y"), ["id", "block_id"])
    fold = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    return joined.select("id", "block_id", T.char_distance(fold("x"), fold("y")).cast("long").alias("distance"), F.length("x").cast("long").alias("n_reference"), F.length("y").cast("long").alias("n_seen"))


@query(sql("b ends ra pa|s AS (SELECT ra.id, CASE WHEN ra.text = pa.text THEN 1.0 ELSE 0.0 END AS e, CAST(length(ra.text) AS DOUBLE) AS n FROM ra JOIN pa ON ra.id = pa.id AND ra.block_id = pa.block_id), m AS (SELECT id, avg(e) AS e FROM s GROUP BY 1)",
    "SELECT count(*) AS n_documents, round(coalesce(avg(e), 0), 6) AS macro_exact, CAST(coalesce(sum(CASE WHEN e = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_all_exact FROM m"))
def eval_macro_exact(spark, d):
    a, b = inputs.engine_pairs(spark, d)
    joined = a.withColumnRenamed("text", "x").join(b.withColumnRenamed("text", "y"), ["id", "block_id"])
    per = joined.groupBy("id").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("e"))
    return per.agg(F.count("*").alias("n_documents"), _R6(F.coalesce(F.avg("e"), F.lit(0.0))).alias("macro_exact"), F.coalesce(F.sum((F.col("e") == 1).cast("long")), F.lit(0)).alias("n_all_exact"))


_IDS = """x AS (SELECT id, list(block_id ORDER BY block_id, text) AS xs FROM ra WHERE block_id IS NOT NULL GROUP BY 1), y AS (SELECT id, list(block_id ORDER BY block_id, text) AS ys FROM pa WHERE block_id IS NOT NULL GROUP BY 1),
 z AS (SELECT id, coalesce(xs, []) AS xs, coalesce(ys, []) AS ys FROM x FULL OUTER JOIN y USING (id))"""


def _id_arrays(spark, d):
    a, b = inputs.engine_pairs(spark, d)
    arrays = [s.where("block_id IS NOT NULL").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda p: p["block_id"]).alias(n)) for s, n in ((a, "xs"), (b, "ys"))]
    none = F.array().cast("array<string>")
    return arrays[0].join(arrays[1], "id", "full_outer").select("id", F.coalesce("xs", none).alias("xs"), F.coalesce("ys", none).alias("ys"))


@query(sql(f"b ends ra pa|{_IDS}, s AS (SELECT id, xs, ys, list_distinct(xs) AS dx, list_distinct(ys) AS dy, len(list_intersect(list_distinct(xs), list_distinct(ys))) AS h FROM z)",
    """SELECT id, round(CASE WHEN len(dy) = 0 THEN (CASE WHEN len(dx) = 0 THEN 1.0 ELSE 0.0 END) ELSE h / len(dy) END, 6) AS "precision", round(CASE WHEN len(dx) = 0 THEN (CASE WHEN len(dy) = 0 THEN 1.0 ELSE 0.0 END) ELSE h / len(dx) END, 6) AS recall,
 h = len(dx) AND h = len(dy) AS exact, xs = ys AS ordered_exact, h = len(dx) AND h = len(dy) AND xs <> ys AS reordered,
 array_to_string(list_filter(xs, lambda x: NOT list_contains(dy, x)), ',') AS missing, array_to_string(list_filter(ys, lambda x: NOT list_contains(dx, x)), ',') AS extra FROM s"""))  # fmt: skip
def block_agreement(spark, d):
    s = E.agreement(F.col("xs"), F.col("ys"))
    return _id_arrays(spark, d).select("id", _R6(s["precision"]).alias("precision"), _R6(s["recall"]).alias("recall"), s["exact"].alias("exact"), s["ordered_exact"].alias("ordered_exact"), s["reordered"].alias("reordered"), F.array_join(s["missing"], ",").alias("missing"), F.array_join(s["extra"], ",").alias("extra"))


@query(sql("b ends ra pa|x AS (SELECT id, block_id, count(*) AS n FROM ra WHERE block_id IS NOT NULL GROUP BY 1, 2), y AS (SELECT id, block_id, count(*) AS n FROM pa WHERE block_id IS NOT NULL GROUP BY 1, 2), j AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS c FROM x FULL OUTER JOIN y ON x.id = y.id AND x.block_id = y.block_id)",
    """SELECT id, round(CASE WHEN sum(c) = 0 THEN 0.0 ELSE sum(least(a, c)) / sum(c) END, 6) AS "precision", round(CASE WHEN sum(a) = 0 THEN 0.0 ELSE sum(least(a, c)) / sum(a) END, 6) AS recall,
 bool_and((a > 0) = (c > 0)) AND max(c) <= 1 AS set_exact, CAST(sum(greatest(a - c, 0)) AS BIGINT) AS n_missing, CAST(sum(greatest(c - a, 0)) AS BIGINT) AS n_extra FROM j GROUP BY 1"""))  # fmt: skip
def block_fidelity(spark, d):
    s = E.fidelity(F.col("xs"), F.col("ys"))
    return _id_arrays(spark, d).select("id", _R6(s["precision"]).alias("precision"), _R6(s["recall"]).alias("recall"), s["set_exact"].alias("set_exact"), F.size(s["missing"]).cast("long").alias("n_missing"), F.size(s["extra"]).cast("long").alias("n_extra"))


@query()
def block_aligned_rates(spark, d):
    """Per document of two engines: distances by block id, unmatched text as insertions."""
    a, b = inputs.engine_pairs(spark, d)
    reference = E.first_per_block(a.where("block_id IS NOT NULL").withColumn("o", F.struct("text")), ["id"], "o")
    seen = b.withColumn("ord", F.xxhash64("block_id", "text"))
    out = E.block_aligned(reference, seen)
    rate = F.when(F.col("length") == 0, (F.col("distance") > 0).cast("double")).otherwise(F.col("distance") / F.col("length"))
    return out.select("id", "distance", "length", _R6(rate).alias("cer"))


@query()
def critical_token_prf(spark, d):
    """Precision, recall and F1 of critical tokens, stored against rebuilt blocks, summed per engine."""
    rows = _rebuilt_against_stored(spark, d).select("engine", Q.critical_tokens(F.col("reference")).alias("a"), Q.critical_tokens(F.col("seen")).alias("b"))
    total = rows.groupBy("engine").agg(F.sum(Q.common_items(F.col("a"), F.col("b"))).alias("hits"), F.sum(F.size("b")).alias("n_seen"), F.sum(F.size("a")).alias("n_reference"))
    p, r, f = Q.prf(F.col("hits"), F.col("n_seen"), F.col("n_reference"))
    return total.select("engine", F.col("hits").cast("long").alias("hits"), F.col("n_seen").cast("long").alias("n_seen"), F.col("n_reference").cast("long").alias("n_reference"), _R6(p).alias("precision"), _R6(r).alias("recall"), _R6(f).alias("f1"))


@query()
def quantity_lcs_prf(spark, d):
    """The same for quantities in order, by longest common subsequence."""
    rows = _rebuilt_against_stored(spark, d).select("engine", Q.quantities(F.col("reference")).alias("a"), Q.quantities(F.col("seen")).alias("b"))
    hits = F.when(F.col("a") == F.col("b"), F.size("a")).otherwise(Q.common_subsequence(F.col("a"), F.col("b")))
    total = rows.groupBy("engine").agg(F.sum(hits).alias("hits"), F.sum(F.size("b")).alias("n_seen"), F.sum(F.size("a")).alias("n_reference"))
    p, r, f = Q.prf(F.col("hits"), F.col("n_seen"), F.col("n_reference"))
    return total.select("engine", F.col("hits").cast("long").alias("hits"), _R6(p).alias("precision"), _R6(r).alias("recall"), _R6(f).alias("f1"))


@query("""SELECT doc_id, regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g') AS text FROM documents""")
def normalize_strict(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strict_text(F.col("text")).alias("text"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(nfc_normalize(text), chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' ')), chr(10)) AS text
 FROM (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\n+|\\n+$', '', 'g') AS text FROM documents)""")
def normalize_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", T.line_text(F.col("text")).alias("text"))


@query()
def normalize_compatible(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.compatible_text(F.col("text")).alias("text"), T.without_punctuation(F.col("text")).alias("bare"))


@query()
def query_category(spark, d):
    """How the query stored with a record differs from the task's own."""
    t = inputs.tasks(spark, d).select("instance_id", "user_query")
    rec = inputs.records(spark, d).select("instance_id", "engine", F.col("user_query").alias("recovered"))
    joined = t.join(rec, "instance_id").where("user_query IS NOT NULL AND recovered IS NOT NULL")
    category = T.difference_category(F.col("user_query"), F.col("recovered"), F.col("recovered"))
    return joined.groupBy("engine", category.alias("category")).agg(F.count("*").alias("n"))


@query()
def char_diff(spark, d):
    """Edit scripts between the blocks of two engines."""
    a, b = inputs.engine_pairs(spark, d)
    joined = a.withColumnRenamed("text", "x").join(b.withColumnRenamed("text", "y"), ["id", "block_id"]).where("x != y")
    return joined.select("id", "block_id", F.explode(T.char_diff("x", "y")).alias("s")).select("id", "block_id", "s.*")


@query(sql("r", """SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(to_json({'n_ok': count(CASE WHEN status = 'ok' THEN 1 END), 'n_failed': count(CASE WHEN status = 'failed' THEN 1 END)}) AS VARCHAR) AS states FROM r GROUP BY 1"""))
def csv_projection(spark, d):
    from quillframe.sources.sinks import flat_csv

    state = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = inputs.results(spark, d).groupBy("name").agg(F.count("*").alias("n"), state("ok").alias("a"), state("failed").alias("b"))
    return flat_csv(out.select("name", "n", F.struct(F.col("a").alias("n_ok"), F.col("b").alias("n_failed")).alias("states")))


QUERIES, SQL = query.queries, query.sql
