"""Command line: ``python -m quillframe COMMAND …``; every command reads tables (Parquet or JSON lines) and writes one."""

from __future__ import annotations

import argparse
import sys

#: Commands, what they take, and what they do.
COMMANDS = {
    "list": ((), "name the queries"),
    "sql": (("name",), "print the SQL a query is checked against"),
    "run": (("name", "sf_dir", "out"), "run a query over a data directory and write it as Parquet"),
    "check-lines": (("path", "out"), "blank, invalid and non-object lines of JSON lines files"),
    "inventory": (("path", "out"), "names, sizes and hashes of all files below a folder"),
    "shards": (("manifest", "seed", "n", "out"), "deal a manifest (instance_id) into balanced shards, one folder each"),
    "merge-check": (("manifest", "results", "runs", "n", "out"), "everything that speaks against merging shard results"),
    "reviews": (("ranges", "overrides", "out"), "one decision per id of review shards"),
    "reviews-check": (("ranges", "overrides", "out"), "rules that review shards break"),
    "screen": (("tasks", "out"), "signals and issue tags of questions (instance_id, user_query)"),
    "overlay": (("screened", "reviews", "out"), "reviews over a screen"),
    "score": (("documents", "out"), "composite scores of documents (id, a, b, xs, ys)"),
    "scorecard": (("documents", "out"), "one line over all documents"),
    "coverage": (("expected", "seen", "key", "out"), "keys missing from or extra in a table"),
}


def _table(spark, path: str):
    return spark.read.json(path) if path.rstrip("/").endswith((".jsonl", ".json")) else spark.read.parquet(path)


def _result(args: argparse.Namespace, spark):
    """The table a command gives."""
    from pyspark.sql import functions as F

    from quillframe.operators import evaluate, merge, plan, rules, screen
    from quillframe.sources import jsonl

    read = lambda *names: [_table(spark, getattr(args, n)) for n in names]
    if args.command == "check-lines":
        return jsonl.strict_violations(jsonl.numbered_lines(spark, args.path, "*"))
    if args.command == "inventory":
        return jsonl.hashed_files(spark, args.path)
    if args.command == "shards":
        return plan.shards(*read("manifest"), "instance_id", args.seed, int(args.n))
    if args.command == "merge-check":
        return merge.merge_violations(*read("manifest", "results", "runs"), int(args.n))
    if args.command == "reviews":
        return merge.expanded_reviews(*read("ranges", "overrides"))
    if args.command == "reviews-check":
        return merge.review_shard_violations(*read("ranges", "overrides"))
    if args.command == "overlay":
        return merge.overlaid(*read("screened", "reviews"))
    if args.command == "screen":
        q = F.col("user_query")
        return read("tasks")[0].select("instance_id", screen.signals(q).alias("signals"), screen.tags(q).alias("tags"))
    if args.command == "coverage":
        return rules.coverage(*read("expected", "seen"), args.key)
    scores = evaluate.instance_scores(*read("documents"))
    return scores if args.command == "score" else evaluate.scorecard(scores)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillframe")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, text) in COMMANDS.items():
        command = commands.add_parser(name, help=text)
        for argument in arguments:
            command.add_argument(argument)
    args = parser.parse_args(argv)
    from quillframe.plans.catalogue import QUERIES, SQL

    if args.command == "list":
        print(*sorted(QUERIES), sep="\n")
        return 0
    if args.command in ("run", "sql") and args.name not in QUERIES:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    if args.command == "sql":
        print(SQL.get(args.name, "none"))
        return 0
    from quillframe.session import get_session, ship

    spark = get_session()
    ship(spark)
    out = QUERIES[args.name](spark, args.sf_dir) if args.command == "run" else _result(args, spark)
    if args.command == "shards":
        from quillframe.sources.sinks import write_shards

        write_shards(out, args.out, "shard")
    else:
        out.write.mode("errorifexists").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
