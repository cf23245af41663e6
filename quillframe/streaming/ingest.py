"""Resumable ingestion: a landing folder of JSON records, read once each, merged by key."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str | StructType, key: str | list[str], attempt: str | list[str]) -> None:
    """Bring everything new in ``landing`` into ``table``: one row per key, the one of the latest attempt.

    Key and attempt may have several columns; of the attempt's, the first counts most.
    The stream's checkpoint remembers which files are done, so a second call reads new files only. Each batch is merged
    with the stored rows into a new version of the table, and only then is that version named the current one.
    """
    keys, attempts = ([c] if isinstance(c, str) else list(c) for c in (key, attempt))
    stream = spark.readStream.schema(schema).json(landing)

    def merge(batch: DataFrame, number: int) -> None:
        now = current(spark, table)
        both = batch if now is None else now.unionByName(batch)
        rest = [c for c in both.columns if c not in keys]
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*attempts)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
        version = f"{table}/version={number:08d}"
        last.write.mode("overwrite").parquet(version)
        Path(table, "CURRENT.tmp").write_text(f"version={number:08d}")
        Path(table, "CURRENT.tmp").replace(Path(table, "CURRENT"))

    Path(table).mkdir(parents=True, exist_ok=True)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The stored rows, or None before the first batch."""
    pointer = Path(table, "CURRENT")
    return spark.read.parquet(f"{table}/{pointer.read_text()}") if pointer.exists() else None


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and totals of events per type and window; works on a stream and on a batch alike (an extension)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
