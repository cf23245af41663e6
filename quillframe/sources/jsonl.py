"""JSON lines, strict and lenient, from files of any number, with exact line numbers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file read at a time.
PIECE = 1 << 20


def numbered_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, line_number, line, ended): every line of every file; ``ended`` is false for a last line without a break."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    text = F.decode("content", "UTF-8")
    whole = files.select(F.col("path").alias("file"), text.alias("text"))
    lines = whole.select("file", F.posexplode(F.split("text", "\n")).alias("i", "line"), F.size(F.split("text", "\n")).alias("n"))
    lines = lines.where(~((F.col("i") == F.col("n") - 1) & (F.col("line") == "")))
    return lines.select("file", (F.col("i") + 1).alias("line_number"), "line", (F.col("i") < F.col("n") - 1).alias("ended"))


def is_json(line: Column) -> Column:
    """Whether a whole line is one JSON value; the parser alone would stop at the end of a leading number or word."""
    closed = F.trim(line).rlike(r'(?s)^(\{.*\}|\[.*\]|".*"|true|false|null|-?\d+(\.\d+)?([eE][+-]?\d+)?)$')
    return F.try_parse_json(line).isNotNull() & closed


def strict_violations(lines: DataFrame) -> DataFrame:
    """(file, line_number, problem): blank lines, lines that are no JSON and lines that are no object."""
    v = F.try_parse_json("line")
    problem = F.when(F.trim("line") == "", "blank").when(~is_json(F.col("line")), "invalid").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")
    return lines.select("file", "line_number", problem.alias("problem")).where("problem IS NOT NULL")


def lenient(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed records without blank lines; a cut last line is flagged ``cut``, any other bad line ``bad``."""
    kept = lines.where(F.trim("line") != "")
    state = F.when(is_json(F.col("line")), "ok").when(~F.col("ended"), "cut").otherwise("bad")
    return kept.select("file", "line_number", state.alias("state"), F.from_json("line", schema).alias("record"))


def hashed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, bytes, sha256) of every file below ``path``; ``file`` is its path from there.

    Only names and sizes are listed as rows; the files are read in the workers in pieces of ``PIECE`` bytes, so that one
    of any size can be hashed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sums = [], []
            for name in batch.column("path").to_pylist():
                system, inner = FileSystem.from_uri(re.sub("^file:/+", "/", name))
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                names.append(name.rpartition("/")[2] if name == base else name.removeprefix(base + "/"))
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("bytes"), pa.array(sums, pa.string())], ["file", "bytes", "sha256"])

    # The list is small and would be one partition; dealt out, the files are hashed side by side.
    listed = files.select("path", F.col("length").alias("bytes")).repartition(spark.sparkContext.defaultParallelism, "path")
    return listed.mapInArrow(run, "file string, bytes long, sha256 string")


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height) read from the header of every PNG file; null where the signature is wrong."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    good = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.when(good, number(17)).alias("width"), F.when(good, number(21)).alias("height"))
