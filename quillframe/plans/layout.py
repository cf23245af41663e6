"""Reading order, page artifacts and rebuilt blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import blocks as B
from quillframe.plans import inputs
from quillframe.plans.inputs import sql
from quillframe.plans.registry import Registry
from quillframe.session import table
from quillframe.sources import engines

query = Registry()
DOC = ["instance_id", "engine"]
_FOLD = "[^\\x00-\\x7F]"


@query()
def block_rebuild(spark, d):
    lines = inputs.lines(spark, d).where("text IS NOT NULL")
    out = B.rebuilt_blocks(B.without_artifacts(lines, DOC), DOC)
    return out.select(*DOC, "seq", "block_id", "text", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"))


@query(sql("l|m AS (SELECT *, regexp_extract(text, '^\\s*[\\[<(]?(b[0-9]+)[\\])>]?[:.]?\\s', 1, 'i') AS mk FROM l WHERE text IS NOT NULL), c AS (SELECT *, count(nullif(mk, '')) OVER (PARTITION BY instance_id, engine ORDER BY page_number, source_order, text, block_id NULLS FIRST, confidence NULLS FIRST ROWS UNBOUNDED PRECEDING) AS seq FROM m)",
    "SELECT instance_id, engine, CAST(seq AS BIGINT) AS seq, lower(max(mk)) AS block_id, count(*) AS n_lines, CAST(min(page_number) AS BIGINT) AS first_page, CAST(max(page_number) AS BIGINT) AS last_page FROM c WHERE seq > 0 GROUP BY 1, 2, 3"))
def block_carry(spark, d):
    """Forward fill of line-start markers: how many lines every block carries."""
    from pyspark.sql import Window

    mk = F.regexp_extract("text", r"(?i)^\s*[\[<(]?(b[0-9]+)[\])>]?[:.]?\s", 1)
    lines = inputs.lines(spark, d).where("text IS NOT NULL").withColumn("mk", F.when(mk != "", mk))
    first = lambda c: F.col(c).asc_nulls_first()
    w = Window.partitionBy(*DOC).orderBy("page_number", "source_order", "text", first("block_id"), first("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    c = lines.withColumn("seq", F.count("mk").over(w)).where("seq > 0")
    return c.groupBy(*DOC, "seq").agg(F.lower(F.max("mk")).alias("block_id"), F.count("*").alias("n_lines"), F.min("page_number").cast("long").alias("first_page"), F.max("page_number").cast("long").alias("last_page"))


@query(sql("l|m AS (SELECT instance_id, engine, page_number, trim(regexp_replace(lower(text), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS k FROM l WHERE text IS NOT NULL AND (bbox.top <= page_height * 0.08 OR bbox.top + bbox.height >= page_height - page_height * 0.08))",
    "SELECT instance_id, engine, regexp_replace(k, '\\bpage\\s+\\d+(\\s+of\\s+\\d+)?\\b', 'page <n>', 'g') AS artifact FROM m WHERE k <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT page_number) >= 2"))
def margin_artifacts(spark, d):
    return B.page_artifacts(inputs.lines(spark, d).where("text IS NOT NULL"), DOC)


@query(sql("l", """SELECT engine, count(*) AS n, CAST(count(CASE WHEN upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) IN ('TRAINING COP', 'TRAINING COPY')
 AND (bbox.height >= page_height * 0.15 OR bbox.width >= page_width * 0.75) THEN 1 END) AS BIGINT) AS n_watermarks,
 CAST(count(CASE WHEN bbox.height >= page_height * 0.15 OR bbox.width >= page_width * 0.75 THEN 1 END) AS BIGINT) AS n_large FROM l GROUP BY 1"""))
def watermark_filter(spark, d):
    b = F.col("bbox")
    mark = B.is_watermark(F.col("text"), b["width"], b["height"], F.col("page_width"), F.col("page_height"))
    large = (b["height"] >= F.col("page_height") * 0.15) | (b["width"] >= F.col("page_width") * 0.75)
    return inputs.lines(spark, d).groupBy("engine").agg(F.count("*").alias("n"), F.count(F.when(mark, 1)).alias("n_watermarks"), F.count(F.when(large, 1)).alias("n_large"))


@query(sql("l|w AS (SELECT instance_id, engine, page_number, source_order, unnest(string_split_regex(text, '\\s+')) AS word, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS k, bbox, confidence FROM (SELECT DISTINCT instance_id, engine, page_number, source_order, text, bbox, confidence FROM l WHERE bbox IS NOT NULL AND text IS NOT NULL))",
    """SELECT instance_id, engine, page_number, count(*) AS n_words, CAST(min(bbox.left) AS BIGINT) AS lft, CAST(min(bbox.top) AS BIGINT) AS tp, CAST(max(bbox.left + bbox.width) AS BIGINT) AS rgt,
 CAST(max(bbox.top + bbox.height) AS BIGINT) AS bot, round(sum(confidence), 4) AS confidence FROM w WHERE word <> '' GROUP BY 1, 2, 3"""))  # fmt: skip
def line_from_words(spark, d):
    l = inputs.lines(spark, d).where("bbox IS NOT NULL AND text IS NOT NULL").select(*DOC, "page_number", "source_order", "text", "bbox", "confidence").distinct()
    w = l.select(*DOC, "page_number", "bbox", "confidence", F.explode(F.split("text", r"\s+")).alias("word")).where("word != ''")
    b = F.col("bbox")
    return w.groupBy(*DOC, "page_number").agg(
        F.count("*").alias("n_words"), F.min(b["left"]).cast("long").alias("lft"), F.min(b["top"]).cast("long").alias("tp"), F.max(b["left"] + b["width"]).cast("long").alias("rgt"),
        F.max(b["top"] + b["height"]).cast("long").alias("bot"), F.round(F.sum("confidence"), 4).alias("confidence"),
    )


@query()
def row_cluster(spark, d):
    return B.rows_in_reading_order(inputs.lines(spark, d), [*DOC, "page_number"])


@query(sql("l|s AS (SELECT instance_id, engine, page_number, source_order, bbox.left / CAST(page_width AS DOUBLE) AS x, bbox.top / CAST(page_height AS DOUBLE) AS y, page_width, page_height FROM l WHERE bbox IS NOT NULL AND text IS NOT NULL)",
    "SELECT instance_id, engine, page_number, count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y FROM s GROUP BY 1, 2, 3"))
def unit_boxes(spark, d):
    """Pixel boxes as unit-square observations and back through the observation scan, per page."""
    l = inputs.lines(spark, d).where("bbox IS NOT NULL AND text IS NOT NULL")
    x, y = F.col("bbox.left") / F.col("page_width").cast("double"), F.col("bbox.top") / F.col("page_height").cast("double")
    return l.groupBy(*DOC, "page_number").agg(F.count("*").alias("n"), F.round(F.sum(x), 4).alias("x"), F.round(F.sum(y), 4).alias("y"))


@query("""SELECT vec_id, CAST(i - 1 AS BIGINT) AS place, CAST(embedding[i] AS DOUBLE) AS score FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def array_zip_lines(spark, d):
    """Parallel arrays as rows."""
    e = table(spark, d, "embeddings")
    zipped = F.arrays_zip(F.col("embedding").alias("e"), F.sequence(F.lit(1), F.size("embedding")).alias("k"))
    return e.select("vec_id", F.posexplode(zipped).alias("place", "z")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("z.e").cast("double").alias("score"))


@query()
def vision_observations(spark, d):
    """Lines as observation JSON, scanned back to pixel lines in the source order."""
    l = inputs.lines(spark, d).where("bbox IS NOT NULL AND text IS NOT NULL")
    w, h = F.col("page_width").cast("double"), F.col("page_height").cast("double")
    box = F.struct((F.col("bbox.left") / w).alias("x"), (F.col("bbox.top") / h).alias("y"), (F.col("bbox.width") / w).alias("width"), (F.col("bbox.height") / h).alias("height"))
    page = l.groupBy(*DOC, "page_number", "page_width", "page_height").agg(F.array_sort(F.collect_list(F.struct("source_order", "text", "confidence", box.alias("bbox")))).alias("o"))
    path = F.concat_ws("/", *DOC, "page_number")
    seen = F.transform("o", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox")))
    js = page.select(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), path.alias("image_path"), F.col("page_width").alias("width"), F.col("page_height").alias("height"), F.lit(0.0).alias("elapsed_ms"), seen.alias("observations"))).alias("value"))
    return engines.lines_of_observations(js, "value")


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_blocks, string_agg(block_id, ',' ORDER BY k) AS ids FROM
 (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^(b[0-9]{2}):', 1)) AS block_id, generate_subscripts(regexp_extract_all(text, '(?m)^(b[0-9]{2}):', 1), 1) AS k FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def marked_documents(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    ids = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"(?m)^(b[0-9]{2}):"), 1).alias("ids")).where("size(ids) > 0")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_blocks"), F.array_join("ids", ",").alias("ids"))


@query()
def pdf_block_rebuild(spark, d):
    """Blocks of documents whose lines start with markers; lines are joined by line breaks."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    pieces = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"(?im)^[ \t]*(b(?:[0-9o]{2}|o[0-9]{2}))\b[ \t]*:?[ \t]*", "\x1e$1\x1f"), "\x1e")).alias("part", "piece")).where("part > 0")
    return pieces.select("doc_id", F.col("part").cast("long").alias("seq"), B.canonical_marker(F.substring_index("piece", "\x1f", 1)).alias("block_id"), F.trim(F.regexp_replace(F.substring_index("piece", "\x1f", -1), r"\s+$", "")).alias("text"))


@query(sql("b", r"""SELECT instance_id, engine, block_id, regexp_replace(text, '(?m)^([bB])[oO]([1-9]):', '\10\2:', 'g') AS text FROM b WHERE text IS NOT NULL"""))
def heading_repair(spark, d):
    return inputs.blocks(spark, d).where("text IS NOT NULL").select("instance_id", "engine", "block_id", F.regexp_replace("text", r"(?m)^([bB])[oO]([1-9]):", r"$10$2:").alias("text"))


@query(sql("b", """SELECT instance_id, engine, block_id, replace(replace(text, '<', '\\u003c'), '>', '\\u003e') AS safe FROM b WHERE text IS NOT NULL"""))
def prompt_escape(spark, d):
    from quillframe.sources.sinks import prompt_safe

    return inputs.blocks(spark, d).where("text IS NOT NULL").select("instance_id", "engine", "block_id", prompt_safe(F.col("text")).alias("safe"))


@query(sql("r|h AS (SELECT instance_id, model_index, replace(replace(replace(replace(replace(regexp_replace(raw_output, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS text FROM r WHERE raw_output LIKE '<%')",
    "SELECT instance_id, model_index, text FROM h"))
def html_text(spark, d):
    text = F.regexp_replace("raw_output", "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return inputs.results(spark, d).where("raw_output LIKE '<%'").select("instance_id", "model_index", text.alias("text"))

#: Outputs that reach each verdict, beside the stored ones.
_OUTPUTS = [("d1", "x" + "a" * 200), ("d2", "b01: " + "a" * 100 + "b" * 100), ("d3", " \n "), ("d4", "a" * 63), ("d5", "b07: some text"), ("d6", "no labels at all"), ("d7", "<b>b24: text</b>"), ("d8", "<p>b01 :</p> x")]
_MADE = ", ".join("('" + i + "', 0, '" + t.replace("\n", "' || chr(10) || '") + "')" for i, t in _OUTPUTS)


@query(sql(f"r|o AS (SELECT instance_id, model_index, raw_output FROM r WHERE raw_output IS NOT NULL UNION ALL SELECT * FROM (VALUES {_MADE})), c AS (SELECT *, regexp_replace(raw_output, '^\\s+|\\s+$', '', 'g') AS t FROM o)",
    """SELECT instance_id, model_index, CASE WHEN t = '' THEN 'empty_output' WHEN length(t) >= 64 AND list_max(list_transform(list_distinct(string_split(t, '')), lambda x: length(t) - length(replace(t, x, '')))) >= 0.95 * length(t) THEN 'degenerate_repeated_character'
 WHEN NOT regexp_matches(regexp_replace(t, '<[^>]+>', ' ', 'g'), '(?i)\\bb(0[1-9]|1[0-9]|2[0-3])\\s*:') THEN 'no_b01_b23_blocks' ELSE 'valid' END AS reason, CAST(length(t) AS BIGINT) AS n_chars FROM c"""))  # fmt: skip
def valid_ocr(spark, d):
    """Whether an output holds a usable reading: some text, not one character repeated, at least one labelled block."""
    made = spark.createDataFrame([(i, 0, t) for i, t in _OUTPUTS], "instance_id string, model_index int, raw_output string")
    rows = inputs.results(spark, d).where("raw_output IS NOT NULL").select("instance_id", "model_index", "raw_output").unionByName(made)
    text = B.stripped(F.col("raw_output"))
    return rows.select("instance_id", "model_index", B.output_reason(F.col("raw_output")).alias("reason"), F.length(text).cast("long").alias("n_chars"))


@query(sql("l q|e AS (SELECT DISTINCT instance_id, unnest(evidence) AS evidence FROM q), n AS (SELECT instance_id, engine, page_number, source_order, text, trim(text) AS line FROM l WHERE trim(text) <> ''), w AS (SELECT *, lead(line) OVER o AS l1, lead(line, 2) OVER o AS l2, row_number() OVER o AS i FROM n WINDOW o AS (PARTITION BY instance_id, engine, page_number ORDER BY source_order, text))",
    """SELECT instance_id, engine, page_number, evidence, arg_min(concat_ws(' ', line, l1, l2), i) AS snippet FROM w JOIN e USING (instance_id)
 WHERE evidence IS NOT NULL AND regexp_matches(evidence, '^[A-Za-z0-9]+$') AND regexp_matches(line, '(?i)^' || evidence || '\\s*:') GROUP BY 1, 2, 3, 4"""))  # fmt: skip
def evidence_snippet(spark, d):
    """Per page, the first line that starts with an evidence id and a colon, with the two lines after it."""
    e = inputs.labels(spark, d).select("instance_id", F.explode("evidence").alias("evidence")).where("evidence RLIKE '^[A-Za-z0-9]+$'").distinct()
    n = inputs.lines(spark, d).where("trim(text) != ''").select("instance_id", "engine", "page_number", "source_order", "text", F.trim("text").alias("line"))
    return B.snippets(n, e, ["instance_id", "engine", "page_number"], ["source_order", "text"])



QUERIES, SQL = query.queries, query.sql
