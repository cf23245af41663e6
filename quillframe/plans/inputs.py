"""The stored tables without repeated rows, as every query uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import table

TASK = ("instance_id", "user_query", "document_pdf", "input_pdf_sha256", "split", "split_seed", "source", "collection_id", "created_at")
BLOCK = ("instance_id", "engine", "block_id", "text")
LINE = ("instance_id", "engine", "page_number", "source_order", "block_id", "text", "bbox", "confidence", "confidence_kind", "page_width", "page_height")
RESULT = ("instance_id", "model_index", "name", "repo", "max_new_tokens", "truncation_risk", "status", "success", "exit_code", "doc_latency_sec", "raw_output", "raw_output_bytes", "raw_output_sha256", "error", "finished_at")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select(*TASK).distinct()


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_blocks").select(*BLOCK).distinct()


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines").select(*LINE).distinct()


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select(*RESULT).distinct()


def records(spark: SparkSession, d: str) -> DataFrame:
    """One row per (instance, engine); a map cannot be compared, so repeats are found by the other columns."""
    return table(spark, d, "ocr_records").dropDuplicates(["instance_id", "engine", "status", "captured_at"])


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_labels").select("instance_id", "answer", "evidence").distinct()


def engine_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents read by two engines: the first engine by name as reference, the last as prediction."""
    b = blocks(spark, d).where("text IS NOT NULL")
    ends = b.groupBy("instance_id").agg(F.min("engine").alias("lo"), F.max("engine").alias("hi")).where("lo < hi")
    joined = b.join(ends, "instance_id")
    side = lambda c: joined.where(F.col("engine") == F.col(c)).select(F.col("instance_id").alias("id"), "block_id", "text")
    return side("lo"), side("hi")


#: The same relations in SQL, by name; a query names those it uses.
CTE = {
    "t": f"t AS (SELECT DISTINCT {', '.join(TASK)} FROM tasks)",
    "b": f"b AS (SELECT DISTINCT {', '.join(BLOCK)} FROM ocr_blocks)",
    "l": f"l AS (SELECT DISTINCT {', '.join(LINE)} FROM ocr_lines)",
    "r": f"r AS (SELECT DISTINCT {', '.join(RESULT)} FROM results)",
    "q": "q AS (SELECT DISTINCT instance_id, answer, evidence FROM qa_labels)",
    "rec": "rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, engine, status, captured_at) AS rn FROM ocr_records) WHERE rn = 1)",
    "ends": "ends AS (SELECT instance_id, min(engine) AS lo, max(engine) AS hi FROM b WHERE text IS NOT NULL GROUP BY 1 HAVING min(engine) < max(engine))",
    "ra": "ra AS (SELECT b.instance_id AS id, block_id, text FROM b JOIN ends USING (instance_id) WHERE engine = lo AND text IS NOT NULL)",
    "pa": "pa AS (SELECT b.instance_id AS id, block_id, text FROM b JOIN ends USING (instance_id) WHERE engine = hi AND text IS NOT NULL)",
}


def sql(names: str, body: str) -> str:
    """A statement over the named relations; ``names`` may end in further definitions after a bar."""
    first, _, more = names.partition("|")
    parts = [CTE[n] for n in first.split()] + ([more.strip()] if more.strip() else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body
