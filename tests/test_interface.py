"""Command line, exported names, retries, limits and managed folders."""

import json

import pytest
from pyspark.sql import functions as F

import quillframe
from quillframe.__main__ import COMMANDS, main
from quillframe.operators import plan
from quillframe.sources import sinks


def test_every_exported_name_exists():
    assert all(callable(getattr(quillframe, n)) for n in quillframe.__all__)
    with pytest.raises(AttributeError):
        quillframe.nothing  # noqa: B018


def test_commands(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "shard_merge_violations" in capsys.readouterr().out
    assert main(["sql", "tag_alias"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "no_such_query", "x", "y"]) == 2
    tasks = spark.createDataFrame([("a", "Is it more than 3?"), ("b", "An unrelated clerk.")], "instance_id string, user_query string")
    tasks.write.parquet(f"{tmp_path}/tasks")
    assert main(["screen", f"{tmp_path}/tasks", f"{tmp_path}/screen"]) == 0
    found = {r.instance_id: (r.signals, r.tags) for r in spark.read.parquet(f"{tmp_path}/screen").collect()}
    assert found == {"a": (["comparison_language"], []), "b": (["distractor_language"], ["distractor_operand_interference"])}
    assert main(["shards", f"{tmp_path}/tasks", "s", "2", f"{tmp_path}/shards"]) == 0
    assert spark.read.json(f"{tmp_path}/shards").count() == 2
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[1]\n')
    assert main(["check-lines", f"{tmp_path}/x.jsonl", f"{tmp_path}/lines"]) == 0
    assert {(r.line_number, r.problem) for r in spark.read.parquet(f"{tmp_path}/lines").collect()} == {(2, "blank"), (3, "not_an_object")}
    docs = spark.createDataFrame([("d", "abcd", "abxd", ["b01"], ["b01"]), ("e", "", "", [], [])], "id string, a string, b string, xs array<string>, ys array<string>")
    docs.write.parquet(f"{tmp_path}/docs")
    assert main(["scorecard", f"{tmp_path}/docs", f"{tmp_path}/card"]) == 0
    card = spark.read.parquet(f"{tmp_path}/card").first()
    assert (card.instances, card.micro_cer, card.macro_cer, card.text_score) == (2, 0.25, 0.125, 75.0)
    assert len(COMMANDS) >= 14


def test_retries_promote_later_successes(spark):
    todo = spark.createDataFrame([(f"k{i}",) for i in range(6)], "k string")
    seen = []

    def attempt(rows, turn):
        seen.append(sorted(r.k for r in rows.collect()))
        good = F.col("k").isin("k0", "k1") if turn == 0 else F.col("k") != "k5"
        return rows.select("k", F.when(good, "ok").otherwise("failed").alias("status"), F.lit(turn).alias("turn"))

    out = {r.k: (r.status, r.turn) for r in plan.retried(todo, attempt, "k", 3).collect()}
    assert out == {"k0": ("ok", 0), "k1": ("ok", 0), "k2": ("ok", 1), "k3": ("ok", 1), "k4": ("ok", 1), "k5": ("failed", 2)}
    assert [len(s) for s in seen] == [6, 4, 1]
    with pytest.raises(ValueError):
        plan.retried(todo, attempt, "k", 0)
    assert [r.k for r in plan.limited(todo, ["k"], 2).collect()] == ["k0", "k1"] and plan.limited(todo, ["k"], None).count() == 6
    with pytest.raises(ValueError):
        plan.limited(todo, ["k"], 0)


def test_managed_folders_and_environment(tmp_path):
    folder = sinks.managed(tmp_path / "out")
    (folder / "old.txt").write_text("x")
    assert [p.name for p in sinks.managed(tmp_path / "out").iterdir()] == [sinks.OWNED]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("mine")
    with pytest.raises(FileExistsError):
        sinks.managed(tmp_path / "other")
    told = json.loads(sinks.environment(("pyspark", "no-such-package")))
    assert told["packages"]["pyspark"] and told["packages"]["no-such-package"] is None
