"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.grouped import grouped
from quillframe.session import cut, table

__all__ = ["cut", "table", "grouped", "words", "histogram", "name_free", "once", "salted_join"]

#: Buckets of every frequency sketch: the driver receives at most this many counters, whatever the input.
SKETCH_BUCKETS = 65_536


def words(text: Column) -> Column:
    """Distinct lower-cased maximal runs of Unicode letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def histogram(keys: DataFrame, column: str, buckets: int = SKETCH_BUCKETS) -> list[int]:
    """Counts of a 64-bit key by bucket; a bounded table, so the driver may hold it and closures may carry it."""
    counted = keys.groupBy(F.pmod(F.col(column), F.lit(buckets)).cast("int").alias("b")).count()
    out = [0] * buckets
    for b, n in counted.collect():
        if b is not None:
            out[b] = n
    return out


def name_free(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra input columns with clashing names cannot disturb an operator."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Rows of one key above which a join deals them into cells.
CELL_ROWS = 20_000


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: int = CELL_ROWS) -> DataFrame:
    """Inner join on ``key``; the rows of a key that ``left`` has more than ``rows`` times lie in several cells, and
    those of ``right`` in each of them, so that no task gets the whole of a hot key.

    ``left`` is read twice, so it should be stored or cheap.
    """
    heavy = left.groupBy(key).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("_cells")).where("_cells > 1")
    cells = F.coalesce("_cells", F.lit(1))
    spread = left.join(heavy, key, "left").withColumn("_cell", F.pmod(F.xxhash64(*left.columns), cells).cast("int")).drop("_cells")
    every = right.join(heavy, key, "left").withColumn("_cell", F.explode(F.sequence(F.lit(0), cells - 1))).drop("_cells")
    return spread.join(every, [key, "_cell"]).drop("_cell")


def once(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` without repeated rows, for tables that hardly have any: only keys and hashes of all rows are shuffled, and
    only rows whose key has a repeat are compared as a whole."""
    hashed = rows.groupBy(key, F.xxhash64(*rows.columns).alias("_h")).count()
    repeated = cut(hashed.where("count > 1").select(key).distinct())
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").distinct())
