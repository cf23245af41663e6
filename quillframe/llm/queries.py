"""Queries of the training-data operators and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import canon, garbled, mixing, neardup, overlap, packing, scan_noise, truncation
from quillframe.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.noisy_items(table(spark, sf_dir, "ocr_lines"), table(spark, sf_dir, "ocr_blocks"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.repaired_blocks(table(spark, sf_dir, "ocr_lines"), table(spark, sf_dir, "ocr_blocks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf_dir, "tasks"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "tasks")
    return overlap.overlap_report(tasks, overlap.cross_split_pairs(tasks))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.shared_spans(table(spark, sf_dir, "tasks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.odd_items(table(spark, sf_dir, "ocr_lines"), table(spark, sf_dir, "ocr_blocks"))


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canonical_items(table(spark, sf_dir, "ocr_lines"), table(spark, sf_dir, "ocr_blocks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(table(spark, sf_dir, "ocr_blocks"), table(spark, sf_dir, "results"))


def p4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, results = table(spark, sf_dir, "ocr_blocks"), table(spark, sf_dir, "results")
    return truncation.cut_share(blocks, results, truncation.judged(blocks, results))


def p4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.evidence_report(truncation.judged_by(table(spark, sf_dir, "ocr_blocks"), table(spark, sf_dir, "results")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "tasks"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf_dir, "tasks"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = table(spark, sf_dir, "containers")
    return packing.packing_report(packing.Packing(table(spark, sf_dir, "documents"), containers), containers)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_documents(table(spark, sf_dir, "documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restored_documents(table(spark, sf_dir, "documents"))


def p8_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.swaps_by_source(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_coverage": p2_coverage,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p4_found": p4_found,
    "p4_share": p4_share,
    "p4_evidence": p4_evidence,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_packed": p6_packed,
    "p6_report": p6_report,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
    "p8_swaps": p8_swaps,
}

_WORDS = r"""
t AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT instance_id, user_query FROM tasks WHERE instance_id IS NOT NULL AND user_query IS NOT NULL)),
w AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(user_query), '[\p{L}\p{N}]+')) AS w FROM t),
n AS (SELECT r, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 12),
k AS (SELECT w.r, w.w, n.n FROM w JOIN n USING (r)),
j AS (SELECT a.r AS x, b.r AS y, count(*) AS shared, any_value(a.n) AS nx, any_value(b.n) AS ny FROM k a JOIN k b ON a.w = b.w AND a.r < b.r GROUP BY 1, 2),
p AS (SELECT DISTINCT least(ta.instance_id, tb.instance_id) AS instance_id_a, greatest(ta.instance_id, tb.instance_id) AS instance_id_b
 FROM j JOIN t ta ON ta.r = x JOIN t tb ON tb.r = y WHERE shared >= 0.75 * (nx + ny - shared) - 1e-9 AND ta.instance_id <> tb.instance_id)"""

_SIDES = r"""
s AS (SELECT DISTINCT instance_id, document_pdf, CASE WHEN f IN ('train') THEN 'train' WHEN f IN ('val', 'validation', 'test') THEN 'eval' END AS side FROM
 (SELECT instance_id, document_pdf, lower(coalesce(split, list_filter(string_split(replace(document_pdf, '\', '/'), '/'), lambda x: x NOT IN ('', '.'))[1])) AS f FROM tasks)),
f AS (SELECT DISTINCT instance_id, side, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(string_split(replace(url_decode(document_pdf), '\', '/'), '/')[-1]),
 '(\.pdf)+$', ''), '([ _-]*\([0-9]+\)|[ _-]+copy)+$', ''), '(\.pdf)+$', ''), '[^a-z0-9]+', '-', 'g'), '-') AS file FROM s WHERE document_pdf IS NOT NULL)"""

#: Only where SQL over all pairs of a small table is affordable; the other queries are tested against brute force.
SQL: dict[str, str] = {
    "p5_found": f"WITH {_WORDS} SELECT * FROM p",
    "p2_found": f"""WITH {_WORDS}, {_SIDES}
 SELECT DISTINCT instance_id_a, instance_id_b FROM p JOIN s a ON a.instance_id = instance_id_a JOIN s b ON b.instance_id = instance_id_b WHERE a.side <> b.side
 UNION SELECT least(a.instance_id, b.instance_id), greatest(a.instance_id, b.instance_id) FROM f a JOIN f b ON a.file = b.file AND a.side = 'train' AND b.side = 'eval' WHERE a.instance_id <> b.instance_id""",
    "p2_report": f"""WITH {_WORDS}, {_SIDES},
 o AS (SELECT DISTINCT instance_id_a, instance_id_b FROM p JOIN s a ON a.instance_id = instance_id_a JOIN s b ON b.instance_id = instance_id_b WHERE a.side <> b.side
 UNION SELECT least(a.instance_id, b.instance_id), greatest(a.instance_id, b.instance_id) FROM f a JOIN f b ON a.file = b.file AND a.side = 'train' AND b.side = 'eval' WHERE a.instance_id <> b.instance_id),
 h AS (SELECT instance_id, min(CASE WHEN name IN ('val', 'validation') THEN 'validation' ELSE name END) AS split_name, coalesce(min(source), 'unknown') AS source FROM
 (SELECT instance_id, source, lower(coalesce(split, list_filter(string_split(replace(document_pdf, '\\', '/'), '/'), lambda x: x NOT IN ('', '.'))[1])) AS name FROM tasks)
 WHERE name IN ('val', 'validation', 'test') GROUP BY 1),
 e AS (SELECT i, count(*) AS n FROM (SELECT instance_id_a AS i FROM o UNION ALL SELECT instance_id_b FROM o) GROUP BY 1)
 SELECT split_name, source, count(*) AS n_tasks, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs FROM h LEFT JOIN e ON i = instance_id GROUP BY 1, 2""",
    "p2_coverage": f"""WITH {_SIDES},
 q AS (SELECT DISTINCT t.instance_id, s.side, regexp_extract_all(lower(coalesce(t.user_query, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM tasks t JOIN s ON s.instance_id = t.instance_id AND s.side IS NOT NULL
 WHERE s.document_pdf IS NOT DISTINCT FROM t.document_pdf),
 g AS (SELECT instance_id, side, w, i, w[i:i + 4] AS span FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM q WHERE len(w) >= 5)),
 c AS (SELECT instance_id, w, count(DISTINCT i + k) AS n FROM g, range(5) r(k) WHERE side = 'eval' AND span IN (SELECT span FROM g WHERE side = 'train') GROUP BY 1, 2),
 u AS (SELECT DISTINCT instance_id, w FROM q WHERE side = 'eval')
 SELECT u.instance_id, CAST(len(u.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_covered, round(CASE WHEN len(u.w) > 0 THEN coalesce(c.n, 0) / len(u.w) ELSE 0.0 END, 6) AS coverage
 FROM u LEFT JOIN c ON c.instance_id = u.instance_id AND c.w = u.w""",
}
