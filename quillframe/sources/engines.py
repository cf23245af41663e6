"""Outputs of recognition engines as line rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.blocks import is_watermark, lines_from_words

WORD_SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
OBSERVATION_SCHEMA = (
    "schema_version string, image_path string, width int, height int, elapsed_ms double, "
    "observations array<struct<text: string, confidence: double, bbox: struct<x: double, y: double, width: double, height: double>>>"
)


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated words with a header, in the fixed schema."""
    return spark.read.csv(path, sep="\t", header=True, schema=WORD_SCHEMA, quote="", enforceSchema=False)


def lines_of_words(words: DataFrame) -> DataFrame:
    """Word rows (level 5) as lines: text in word order, union of boxes, mean confidence within 0..1."""
    kept = words.where("level = 5 AND trim(text) != ''").withColumn("word", F.trim("text"))
    return lines_from_words(kept, ["page_num", "block_num", "par_num", "line_num"])


def lines_of_observations(rows: DataFrame, column: str) -> DataFrame:
    """JSON lines of unit-square observations as pixel lines without the known watermark.

    Pixels are rounded half to even. A record of another schema version or with a box outside the page gives no line.
    """
    parsed = rows.select(F.from_json(column, OBSERVATION_SCHEMA).alias("r")).where("r.schema_version = '1.0'")
    seen = parsed.select("r.image_path", "r.width", "r.height", F.posexplode("r.observations").alias("source_order", "o"))
    b = F.col("o.bbox")
    inside = (b["x"] >= 0) & (b["y"] >= 0) & (b["x"] + b["width"] <= 1.000001) & (b["y"] + b["height"] <= 1.000001)
    pixel = lambda v, size: F.bround(v * F.col(size), 0).cast("int")
    lines = seen.where(inside).select(
        "image_path", "source_order", F.col("o.text").alias("text"), F.col("o.confidence").alias("confidence"),
        pixel(b["x"], "width").alias("left"), pixel(b["y"], "height").alias("top"), pixel(b["width"], "width").alias("box_width"), pixel(b["height"], "height").alias("box_height"),
        F.col("width").alias("page_width"), F.col("height").alias("page_height"),
    )
    return lines.where(~is_watermark(F.col("text"), F.col("box_width"), F.col("box_height"), F.col("page_width"), F.col("page_height")))


def lines_of_arrays(rows: DataFrame, key: str, texts: str, scores: str, boxes: str) -> DataFrame:
    """Parallel arrays of texts, scores and corner boxes as lines; rows whose arrays differ in length are no lines."""
    same = (F.size(texts) == F.size(scores)) & (F.size(texts) == F.size(boxes))
    zipped = F.arrays_zip(F.col(texts).alias("t"), F.col(scores).alias("s"), F.col(boxes).alias("b"))
    items = rows.where(same).select(key, F.posexplode(zipped).alias("source_order", "i"))
    box = F.col("i.b")
    return items.select(key, "source_order", F.col("i.t").alias("text"), F.col("i.s").alias("score"), box[0].alias("left"), box[1].alias("top"), (box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height"))
