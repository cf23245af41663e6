"""Content hashes and the deterministic order keys built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_sha(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by NUL characters."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    joined = [columns[0]]
    for c in columns[1:]:
        joined += [F.lit("\x00"), c]
    return F.sha2(F.concat(*joined), 256)


def record_sha(columns: list[str]) -> Column:
    """SHA-256 of a record as JSON with its keys sorted and nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def total_sha(df: DataFrame, id_column: str, sha_column: str) -> DataFrame:
    """One hash over all (id, hash) entries in id order: a tree of two levels, so no task holds every entry."""
    part = df.select(F.substring(F.sha2(F.col(id_column), 256), 1, 3).alias("p"), id_column, sha_column)
    leaf = part.groupBy("p").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(id_column, sha_column))), lambda e: F.concat(e[id_column], F.lit(":"), e[sha_column])), ","), 256).alias("h"), F.count("*").alias("n"))
    return leaf.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda e: e["h"]), ","), 256).alias("total_sha"), F.sum("n").cast("long").alias("n_records"))


def ranked(df: DataFrame, key: Column, tie: str, name: str = "rank", buckets: int = 1_024) -> DataFrame:
    """Zero-based rank of every row by a hex ``key`` and ``tie``, without one global sort.

    Rows are ranked within buckets of the key's leading digits; the offsets of the buckets are a bounded table.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.conv(F.substring("_key", 1, 4), 16, 10).cast("long"))
    keyed = keyed.withColumn("_bucket", F.floor(F.col("_bucket") / (65_536 // buckets)).cast("int"))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", tie))
    joined = keyed.withColumn("_inner", inner).join(F.broadcast(offsets.select("_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))), "_bucket")
    return joined.withColumn(name, F.col("_before") + F.col("_inner") - 1).drop("_bucket", "_inner", "_before")
