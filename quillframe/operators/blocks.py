"""Layout: reading order, page artifacts, and blocks rebuilt from marked lines."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import collapse_blanks
from quillframe.operators.grouped import grouped

# Marker forms, footers and watermark texts that layout recognises.
MARKER = r"(?i)(?<![A-Za-z0-9])(?:[\[<(]\s*)?(b\d+)(?:\s*[\])>])?(?![A-Za-z0-9])(?:\s*[:.])?"
LETTER_O_MARKER = r"^(\s*(?:[\[<(]\s*)?[bB])[oO](0?)([1-9](?:\s*[\])>])?\s*[:.])(?=\s|$)"
PAGE_FOOTER = r"(?i)^page\s+\d+(?:\s+of\s+\d+)?$"
PAGE_PHRASE = r"(?i)\bpage\s+\d+(?:\s+of\s+\d+)?\b"
WATERMARKS = ("TRAINING COP", "TRAINING COPY")
MARGIN = 0.08

_OPEN, _CLOSE = "\x1e", "\x1f"


def repaired_marker(text: Column) -> Column:
    """A marker at the start of a line whose zero was read as the letter O, with its zero."""
    return F.regexp_replace(text, LETTER_O_MARKER, "$10$3")


def canonical_marker(marker: Column) -> Column:
    """``bO9``, ``bo09`` and ``b09`` as ``b09``."""
    digits = F.substring(F.lower(marker), 2, 10)
    digits = F.when((F.length(digits) == 3) & digits.startswith("o"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.concat(F.lit("b"), F.translate(digits, "o", "0"))


def is_margin(top: Column, height: Column, page_height: Column, ratio: float = MARGIN) -> Column:
    """Whether a box touches the upper or lower margin of its page."""
    return F.coalesce((top <= page_height * ratio) | (top + height >= page_height - page_height * ratio), F.lit(False))


def artifact_key(text: Column) -> Column:
    """Text of a margin line without case, blanks and page numbers."""
    return F.regexp_replace(collapse_blanks(F.lower(text)), PAGE_PHRASE, "page <n>")


def is_watermark(text: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """A known watermark text in a box far larger than a line."""
    large = (height >= page_height * 0.15) | (width >= page_width * 0.75)
    return F.coalesce(collapse_blanks(F.upper(text)).isin(*WATERMARKS) & large, F.lit(False))


def page_artifacts(lines: DataFrame, document: list[str]) -> DataFrame:
    """(document columns, artifact): margin texts that occur on at least two pages of a document."""
    margin = lines.where(is_margin(F.col("bbox.top"), F.col("bbox.height"), F.col("page_height")))
    keyed = margin.withColumn("artifact", artifact_key(F.col("text"))).where("artifact != ''")
    # Two different pages show in the extremes; no set of pages is gathered.
    return keyed.groupBy(*document, "artifact").agg(F.min("page_number").alias("lo"), F.max("page_number").alias("hi")).where("lo < hi").select(*document, "artifact")


def without_artifacts(lines: DataFrame, document: list[str]) -> DataFrame:
    """Lines that are neither a footer nor a margin text repeated across pages."""
    repeated = page_artifacts(lines, document).withColumn("_hit", F.lit(True))
    inside = ~is_margin(F.col("bbox.top"), F.col("bbox.height"), F.col("page_height"))
    keyed = lines.withColumn("artifact", F.when(inside, None).otherwise(artifact_key(F.col("text"))))
    kept = keyed.join(repeated, [*document, "artifact"], "left").where("_hit IS NULL")
    return kept.where(~F.trim("text").rlike(PAGE_FOOTER)).drop("artifact", "_hit")


def rebuilt_blocks(lines: DataFrame, document: list[str]) -> DataFrame:
    """(document columns, seq, block_id, text, first_page, last_page): the blocks of every document in reading order.

    A marker opens a block and closes the one before; text before the first marker belongs to none; parts are joined by
    one space. Two adjacent markers of one id give two blocks.
    """
    marked = F.regexp_replace(repaired_marker(F.col("text")), MARKER, f"{_OPEN}$1{_CLOSE}")
    parts = lines.select(*document, "page_number", "source_order", F.posexplode(F.split(marked, _OPEN)).alias("part", "piece"))
    parts = parts.withColumn("opens", F.when((F.col("part") > 0), F.lower(F.substring_index("piece", _CLOSE, 1))))
    parts = parts.withColumn("body", F.trim(F.when(F.col("part") > 0, F.substring_index("piece", _CLOSE, -1)).otherwise(F.col("piece"))))
    order = Window.partitionBy(*document).orderBy("page_number", "source_order", "part").rowsBetween(Window.unboundedPreceding, 0)
    carried = parts.withColumn("seq", F.count("opens").over(order)).where("seq > 0")
    place = F.struct("page_number", "source_order", "part", F.col("body").alias("body"))
    blocks = carried.groupBy(*document, "seq").agg(
        F.max("opens").alias("block_id"),
        F.array_sort(F.collect_list(place)).alias("parts"),
        F.min("page_number").alias("first_page"),
        F.max("page_number").alias("last_page"),
    )
    text = F.array_join(F.filter(F.transform("parts", lambda p: p["body"]), lambda b: b != ""), " ")
    return blocks.select(*document, F.col("seq").cast("long").alias("seq"), "block_id", text.alias("text"), "first_page", "last_page")


def rows_in_reading_order(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page columns, source_order, row, place): boxes clustered into rows, then left to right.

    A box joins the row whose running mean top is nearest, if it lies within half the row's median height (at least 2,
    at most 24 pixels) and the heights differ by a factor of at most 2.5. The state is sequential, so one page is one
    group; a page is the bound of a group.
    """
    kinds = dict(lines.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in page) + ", source_order int, row int, place int"
    columns = [*page, "source_order", "left", "top", "height"]

    def cluster(boxes: list[tuple]) -> Iterator[tuple[int, int, int]]:
        """(source_order, row, place) of the (source_order, left, top, height) boxes of one page."""
        rows: list[dict] = []
        for order, left, top, height in sorted(boxes, key=lambda b: (b[2], b[1], b[0])):
            best = None
            for row in rows:
                near = abs(top - row["top"])
                if near > 24.0 or (best is not None and near >= best[0]):
                    continue
                heights = row["heights"]  # kept in order
                mid = len(heights) // 2
                typical = heights[mid] if len(heights) % 2 else (heights[mid - 1] + heights[mid]) / 2
                if max(typical, height) <= 2.5 * max(min(typical, height), 1) and near <= min(max(typical / 2, 2.0), 24.0):
                    best = near, row
            if best is None:
                rows.append({"top": float(top), "heights": [height], "total": top, "boxes": [(left, order)]})
            else:
                row = best[1]
                bisect.insort(row["heights"], height)
                row["total"] += top
                row["boxes"].append((left, order))
                row["top"] = row["total"] / len(row["boxes"])
        place = 0
        for k, row in enumerate(sorted(rows, key=lambda r: r["top"])):
            for _, order in sorted(row["boxes"], key=lambda b: b[0]):
                yield order, k, place
                place += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = list(zip(*(part.column(c).to_pylist() for c in page)))
            boxes = list(zip(*(part.column(c).to_pylist() for c in columns[len(page) :])))
            out, start = [], 0
            for end in range(1, len(keys) + 1):
                if end == len(keys) or keys[end] != keys[start]:
                    out += [(*keys[start], *r) for r in cluster(boxes[start:end])]
                    start = end
            types = [part.schema.field(c).type for c in page] + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*page, "source_order", "row", "place"])

        yield from grouped(batches, page, work)

    flat = lines.where("bbox IS NOT NULL").select(*page, "source_order", F.col("bbox.left").alias("left"), F.col("bbox.top").alias("top"), F.col("bbox.height").alias("height"))
    return flat.repartition(*page).sortWithinPartitions(*page, "source_order").mapInArrow(run, schema)


def lines_from_words(words: DataFrame, line: list[str]) -> DataFrame:
    """(line columns, text, left, top, right, bottom, confidence): words in order, their box and mean confidence."""
    return words.groupBy(*line).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "word"))), lambda w: w["word"]), " ").alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        (F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100).alias("confidence"),
    )


def engine_lines(images: DataFrame, recognise, schema: str) -> DataFrame:
    """Run a recognition engine over image rows; ``recognise`` is made once per partition and yields line rows.

    ``recognise()`` returns a callable from a pandas batch to a pandas frame of ``schema``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = recognise()
        for batch in batches:
            yield engine(batch)

    return images.mapInPandas(run, schema)


def stripped(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def output_reason(text: Column) -> Column:
    """``valid``, or why an output is no usable reading: empty, one character for 95 % of 64 or more, no block b01 to b23."""
    t = stripped(text)
    most = F.array_max(F.transform(F.array_distinct(F.split(t, "")), lambda c: F.length(t) - F.length(F.replace(t, c, F.lit("")))))
    labelled = F.regexp_replace(t, "<[^>]+>", " ").rlike(r"(?i)\bb(0[1-9]|1[0-9]|2[0-3])\s*:")
    return F.when(t == "", "empty_output").when((F.length(t) >= 64) & (most >= 0.95 * F.length(t)), "degenerate_repeated_character").when(~labelled, "no_b01_b23_blocks").otherwise("valid")


def snippets(lines: DataFrame, evidence: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """(page columns, evidence, snippet): the first line of a page that opens with an evidence id and a colon, and the two
    lines after it.  ``lines`` are trimmed and not empty; ``evidence`` (instance_id, evidence) holds plain ids."""
    w = Window.partitionBy(*page).orderBy(*order)
    rows = lines.withColumn("snippet", F.concat_ws(" ", "line", F.lead("line").over(w), F.lead("line", 2).over(w))).withColumn("i", F.row_number().over(w))
    # Only lines that open with some id meet the evidence.
    opened = rows.withColumn("id", F.lower(F.regexp_extract("line", r"^([A-Za-z0-9]+)\s*:", 1))).where("id != ''")
    hits = opened.join(evidence.withColumn("id", F.lower("evidence")), ["instance_id", "id"])
    return hits.groupBy(*page, "evidence").agg(F.min_by("snippet", "i").alias("snippet"))
