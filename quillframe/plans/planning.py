"""Splits, shards, batches, resume, shard merges, file inventories and resumable ingestion."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from quillframe.functions.hashing import text_sha
from quillframe.operators import blocks as B
from quillframe.operators import plan as P
from quillframe.plans import inputs
from quillframe.plans.inputs import sql
from quillframe.plans.registry import Registry
from quillframe.session import table

query = Registry()
SEED = "quillframe-split-1"
_KEY = f"sha256('{SEED}' || chr(0) || instance_id || chr(0) || input_pdf_sha256)"
_ONE = "k AS (SELECT DISTINCT instance_id, input_pdf_sha256 FROM t WHERE input_pdf_sha256 IS NOT NULL)"


def _keys(spark, d):
    return inputs.tasks(spark, d).where("input_pdf_sha256 IS NOT NULL").select("instance_id", "input_pdf_sha256").distinct()


@query(sql(f"t|{_ONE}", f"SELECT instance_id FROM k ORDER BY {_KEY}, instance_id LIMIT 30"))
def dev_split_top30(spark, d):
    """The 30 rows with the smallest salted hash (the sampling operator's size)."""
    return P.held_out(_keys(spark, d), "instance_id", SEED, 30, F.col("input_pdf_sha256")).select("instance_id")


@query(sql(f"t|{_ONE}", f"SELECT instance_id, CAST((row_number() OVER (ORDER BY {_KEY}, instance_id) - 1) % 8 AS INTEGER) AS shard FROM k"))
def shard_assignment(spark, d):
    return P.shards(_keys(spark, d), "instance_id", SEED, 8, F.col("input_pdf_sha256")).select("instance_id", "shard")


@query(sql(f"t|{_ONE}, s AS (SELECT instance_id, CAST((row_number() OVER (ORDER BY {_KEY}, instance_id) - 1) % 8 AS INTEGER) AS shard FROM k)",
    "SELECT shard, count(*) AS n, min(instance_id) AS first_id, max(instance_id) AS last_id, printf('shard-%02d-of-08.jsonl', shard) AS file FROM s GROUP BY 1"))
def shard_manifest_sink(spark, d):
    s = P.shards(_keys(spark, d), "instance_id", SEED, 8, F.col("input_pdf_sha256"))
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.min("instance_id").alias("first_id"), F.max("instance_id").alias("last_id")).withColumn("file", F.format_string("shard-%02d-of-08.jsonl", "shard"))


@query(sql(f"t|{_ONE}, s AS (SELECT (row_number() OVER (ORDER BY {_KEY}, instance_id) - 1) % 8 AS shard FROM k), c AS (SELECT shard, count(*) AS n FROM s GROUP BY 1)",
    "SELECT max(n) - min(n) <= 1 AS balanced, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_shards FROM c"))
def shard_balance(spark, d):
    s = P.shards(_keys(spark, d), "instance_id", SEED, 8, F.col("input_pdf_sha256")).groupBy("shard").agg(F.count("*").alias("n"))
    return s.agg((F.max("n") - F.min("n") <= 1).alias("balanced"), F.sum("n").cast("long").alias("n"), F.count("*").alias("n_shards"))


@query(sql("t|k AS (SELECT DISTINCT instance_id FROM t), s AS (SELECT instance_id, row_number() OVER (ORDER BY sha256('packet:' || instance_id), instance_id) - 1 AS i FROM k)",
    "SELECT instance_id, printf('batch-%04d', i // 7 + 1) AS batch, CAST(i % 7 + 1 AS INTEGER) AS ordinal FROM s"))
def batch_packets(spark, d):
    return P.batches(inputs.tasks(spark, d).select("instance_id").distinct(), "instance_id", "packet:", 7).select("instance_id", "batch", "ordinal")


@query(sql("rec t|p AS (SELECT t.instance_id, min(CASE WHEN rec.status = 'ok' THEN 2 WHEN rec.status = 'failed' THEN 1 ELSE 0 END) AS priority FROM t LEFT JOIN rec USING (instance_id) GROUP BY 1)",
    "SELECT instance_id, CAST(priority AS INTEGER) AS priority FROM p"))
def retry_priority(spark, d):
    t, r = inputs.tasks(spark, d).select("instance_id"), inputs.records(spark, d).select("instance_id", "status")
    level = F.when(F.col("status") == "ok", 2).when(F.col("status") == "failed", 1).otherwise(0)
    return t.join(r, "instance_id", "left").groupBy("instance_id").agg(F.min(level).alias("priority"))


@query(sql("rec t", "SELECT DISTINCT instance_id, sha256(coalesce(user_query, '')) AS fingerprint FROM t WHERE instance_id NOT IN (SELECT instance_id FROM rec WHERE status = 'ok')"))
def resume_pending(spark, d):
    wanted = inputs.tasks(spark, d).select("instance_id", F.sha2(F.coalesce("user_query", F.lit("")), 256).alias("fingerprint")).distinct()
    done = inputs.records(spark, d).where("status = 'ok'").select("instance_id", "status", F.sha2(F.coalesce("user_query", F.lit("")), 256).alias("fingerprint")).dropDuplicates(["instance_id"])
    return P.pending(wanted, done, "instance_id", "fingerprint")[0]


@query(sql("rec t", "SELECT DISTINCT t.instance_id FROM t JOIN rec USING (instance_id) WHERE rec.status = 'ok' AND coalesce(t.user_query, '') <> coalesce(rec.user_query, '')"))
def resume_stale(spark, d):
    wanted = inputs.tasks(spark, d).select("instance_id", F.coalesce("user_query", F.lit("")).alias("fingerprint"))
    done = inputs.records(spark, d).select("instance_id", "status", F.coalesce("user_query", F.lit("")).alias("fingerprint"))
    return P.pending(wanted, done, "instance_id", "fingerprint")[1].select("instance_id").distinct()


@query(sql("t", f"SELECT instance_id, substr(sha256('sample:' || instance_id), 1, 2) < '1a' AS sampled FROM t"))
def hash_sample(spark, d):
    """A tenth of the rows by hash, the same in every run."""
    return inputs.tasks(spark, d).select("instance_id", (F.substring(F.sha2(F.concat(F.lit("sample:"), F.col("instance_id")), 256), 1, 2) < "1a").alias("sampled"))


@query()
def file_inventory(spark, d):
    """Names, sizes and hashes of the stored tables' files: every Parquet file below the data directory."""
    from quillframe.session import ship
    from quillframe.sources.jsonl import hashed_files

    ship(spark)
    return hashed_files(spark, d, "*.parquet")


@query()
def stream_ingest(spark, d):
    """All records landed twice and ingested as a stream: one row per key, of the latest attempt."""
    from quillframe.session import checkpoint_folder
    from quillframe.streaming import ingest

    base = tempfile.mkdtemp(prefix="ingest-", dir=checkpoint_folder(spark).removeprefix("file:"))
    records = table(spark, d, "ocr_records")
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    for attempt in (1, 2):
        rows = records.withColumn("attempt", F.lit(attempt))
        rows.write.mode("append").options(timestampFormat=f"{micros}XXX", timestampNTZFormat=micros).json(f"{base}/landing")
        ingest.ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/offsets", rows.schema, ["instance_id", "engine"], ["attempt", "received_at", "captured_at"])
    return ingest.current(spark, f"{base}/table")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    """Tumbling windows over events: an extension beyond resumable batches."""
    from quillframe.streaming.ingest import windowed

    return windowed(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def udtf_engine(spark, d):
    """A recognition engine behind the engine protocol: an in-memory one that reads document lines."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")

    def recognise():
        import pandas as pd

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            out = [(int(i), k, line) for i, text in zip(batch["doc_id"], batch["text"]) for k, line in enumerate(text.split("\n"))]
            return pd.DataFrame(out, columns=["doc_id", "source_order", "text"])

        return run

    return B.engine_lines(docs, recognise, "doc_id long, source_order int, text string")


@query(sql("l", "SELECT instance_id, engine, page_number, source_order, coalesce(confidence_kind, 'none') AS confidence_kind, bbox.left + bbox.width AS rgt, bbox.top + bbox.height AS bot, bbox IS NULL AS no_box FROM l"))
def record_projection(spark, d):
    return inputs.lines(spark, d).select("instance_id", "engine", "page_number", "source_order", F.coalesce("confidence_kind", F.lit("none")).alias("confidence_kind"), (F.col("bbox.left") + F.col("bbox.width")).alias("rgt"), (F.col("bbox.top") + F.col("bbox.height")).alias("bot"), F.col("bbox").isNull().alias("no_box"))

@query(sql("t", f"""SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, ',' ORDER BY p)) AS fingerprint FROM
 (SELECT source, substr(k, 1, 3) AS p, count(*) AS n, sha256(string_agg(k, ',' ORDER BY k)) AS h FROM (SELECT DISTINCT source, {_KEY} AS k FROM t WHERE input_pdf_sha256 IS NOT NULL AND source IS NOT NULL) GROUP BY 1, 2) GROUP BY 1"""))  # fmt: skip
def fingerprints(spark, d):
    """A fingerprint per source over the hashes of its rows: a tree of two levels, so no task holds a whole source."""
    t = inputs.tasks(spark, d).where("input_pdf_sha256 IS NOT NULL AND source IS NOT NULL")
    k = t.select("source", text_sha(F.lit(SEED), F.col("instance_id"), F.col("input_pdf_sha256")).alias("k")).distinct()
    leaf = k.groupBy("source", F.substring("k", 1, 3).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda e: e["h"]), ",")
    return leaf.groupBy("source").agg(F.sum("n").cast("long").alias("n"), F.sha2(joined, 256).alias("fingerprint"))


QUERIES, SQL = query.queries, query.sql
