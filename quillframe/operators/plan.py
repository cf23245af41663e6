"""Deterministic plans: splits, balanced shards, batches, resume and consensus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.hashing import ranked, text_sha
from quillframe.session import cut


def shards(df: DataFrame, key: str, seed: str, n: int, *parts: Column) -> DataFrame:
    """``shard``: the rank of the salted hash modulo ``n``, so that shard sizes differ by one at most."""
    if n < 1:
        raise ValueError("at least one shard")
    out = ranked(df, text_sha(F.lit(seed), F.col(key), *parts), key)
    return out.withColumn("shard", F.pmod("rank", F.lit(n)).cast("int"))


def held_out(df: DataFrame, key: str, seed: str, n: int, *parts: Column) -> DataFrame:
    """The ``n`` rows with the smallest salted hash: a bounded heap per task, no global sort."""
    return df.withColumn("_key", text_sha(F.lit(seed), F.col(key), *parts)).orderBy("_key", key).limit(n)


def batches(df: DataFrame, key: str, salt: str, size: int) -> DataFrame:
    """``batch`` (zero-padded) and ``ordinal`` in salted-hash order."""
    out = ranked(df, F.sha2(F.concat(F.lit(salt), F.col(key)), 256), key)
    number = F.floor(F.col("rank") / size).cast("int") + 1
    return out.withColumn("batch", F.format_string("batch-%04d", number)).withColumn("ordinal", (F.col("rank") % size + 1).cast("int"))


def pending(wanted: DataFrame, done: DataFrame, key: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(pending, stale): rows still to do, and rows done under another fingerprint."""
    finished = done.where("status = 'ok'").select(key, F.col(fingerprint).alias("_done"))
    joined = wanted.join(finished, key, "left")
    return joined.where("_done IS NULL").drop("_done"), joined.where(F.col("_done") != F.col(fingerprint)).drop("_done")


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last attempt of every key, without sorting: one ordered maximum per group."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def unanimous(passes: DataFrame, key: str, decision: list[str], n_passes: int) -> DataFrame:
    """(key, n_passes, n_decisions, unanimous): whether all passes made the same decision."""
    out = passes.groupBy(key).agg(F.countDistinct("pass_no").alias("n_passes"), F.countDistinct(F.struct(*decision)).alias("n_decisions"))
    return out.withColumn("unanimous", (F.col("n_passes") == n_passes) & (F.col("n_decisions") == 1))


def route(same: Column, reliable: Column, confirmed: Column) -> Column:
    """Where a reviewed row goes: confirmed, excluded, candidate or needs_review."""
    return F.when(same & reliable, "confirmed").when(~same & confirmed, "excluded").when(reliable, "candidate").otherwise("needs_review")


def limited(todo: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows still to do; no number means all, and one below 1 is an error, not an empty run."""
    if n is None:
        return todo
    if n < 1:
        raise ValueError("a limit is at least 1")
    return todo.orderBy(*order).limit(n)


def retried(todo: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], key: str, rounds: int) -> DataFrame:
    """``attempt(rows, round)`` on all rows, then on those that failed, in at most ``rounds`` rounds.

    An attempt gives one row per key with a ``status``.  A later round's result takes the place of an earlier failure; what
    never succeeds keeps its last failure.  Every round is stored, so a lost executor repeats none of the earlier ones.
    """
    if rounds < 1:
        raise ValueError("at least one round")
    done, rest = None, todo
    for turn in range(rounds):
        now = cut(attempt(rest, turn))
        good = now.where("status = 'ok'")
        failed = now.where("coalesce(status, '') != 'ok'")
        done = good if done is None else done.unionByName(good)
        if turn == rounds - 1 or failed.isEmpty():
            return done.unionByName(failed)
        rest = rest.join(failed.select(key), key, "left_semi")
    return done
