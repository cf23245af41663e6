"""Layout, rules, plans, screens, sources, sinks and ingestion on small inputs."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillframe.operators import blocks as B
from quillframe.operators import evaluate as E
from quillframe.operators import merge
from quillframe.operators import plan as P
from quillframe.operators import rules as R
from quillframe.operators import screen as S
from quillframe.plans.catalogue import QUERIES
from quillframe.sources import engines, jsonl, sinks
from quillframe.streaming import ingest


def page(spark, rows):
    data = [("d", i // 100 + 1, i % 100, t) for i, t in rows]
    return spark.createDataFrame(data, "doc string, page_number int, source_order int, text string")


@pytest.mark.parametrize(
    "lines,want",
    [
        (["b01: one", "two", "b02. three"], [("b01", "one two"), ("b02", "three")]),
        (["lost", "[B01] x"], [("b01", "x")]),
        (["b01: a b02: c", "d"], [("b01", "a"), ("b02", "c d")]),
        (["bO5: x"], [("b05", "x")]),
        (["b01: a", "b01: c"], [("b01", "a"), ("b01", "c")]),
        (["(b03) y", "", "z"], [("b03", "y z")]),
        (["no marker"], []),
        (["ab01: x"], []),
    ],
)
def test_rebuilt_blocks(spark, lines, want):
    out = B.rebuilt_blocks(page(spark, list(enumerate(lines))), ["doc"]).orderBy("seq").collect()
    assert [(r.block_id, r.text) for r in out] == want


def test_blocks_span_pages(spark):
    out = B.rebuilt_blocks(page(spark, [(0, "b01: one"), (100, "two")]), ["doc"]).first()
    assert (out.text, out.first_page, out.last_page) == ("one two", 1, 2)


def test_artifacts_need_two_pages_and_the_margin(spark):
    schema = "doc string, page_number int, source_order int, text string, bbox struct<left:int,top:int,width:int,height:int>, page_height int"
    rows = [("d", p, 0, "Head Page %d of 2" % p, (0, 5, 10, 10), 1000) for p in (1, 2)] + [("d", 1, 1, "Body", (0, 500, 10, 10), 1000), ("d", 2, 1, "Body", (0, 500, 10, 10), 1000), ("d", 1, 2, "page 1 of 2", (0, 990, 5, 5), 1000), ("d", 1, 3, "once", (0, 4, 1, 1), 1000)]
    df = spark.createDataFrame(rows, schema)
    assert [r.artifact for r in B.page_artifacts(df, ["doc"]).collect()] == ["head page <n>"]
    assert sorted(r.text for r in B.without_artifacts(df, ["doc"]).collect()) == ["Body", "Body", "once"]


def test_reading_order_clusters_rows(spark):
    schema = "doc string, source_order int, bbox struct<left:int,top:int,width:int,height:int>"
    rows = [("d", 0, (100, 12, 10, 20)), ("d", 1, (0, 10, 10, 20)), ("d", 2, (0, 60, 10, 20)), ("d", 3, (50, 11, 10, 90)), ("d", 4, None)]
    out = B.rows_in_reading_order(spark.createDataFrame(rows, schema), ["doc"]).orderBy("place").collect()
    assert [r.source_order for r in out] == [1, 0, 3, 2]
    assert [r.row for r in out] == [0, 0, 1, 2]


def test_watermark(spark):
    df = spark.createDataFrame([("Training  copy", 10, 200), ("training copy", 10, 20), ("other", 900, 900)], "t string, w int, h int")
    assert [r[0] for r in df.select(B.is_watermark(F.col("t"), F.col("w"), F.col("h"), F.lit(1000), F.lit(1000))).collect()] == [True, False, False]


def test_canonical_marker(spark):
    df = spark.createDataFrame([("bO09",), ("b09",), ("bo9",)], "m string")
    assert [r[0] for r in df.select(B.canonical_marker(F.col("m"))).collect()] == ["b09", "b09", "b09"]


def test_rules_report_all_and_gate_raises(spark):
    good = ("task_1", "42", ["b01"])
    bad = [("", "4 2", []), ("t", None, ["b1", "b02"]), ("u", "1", ["b01", "b01"]), ("v", "1", None)]
    df = spark.createDataFrame([good, *bad], "instance_id string, answer string, evidence array<string>")
    found = {(r.instance_id, r.rule) for r in R.violations(df, ["instance_id"], R.submission_rules()).collect()}
    assert found == {("", "bad_id"), ("", "bad_answer"), ("", "empty_evidence"), ("t", "bad_answer"), ("t", "bad_block_id"), ("u", "repeated_block_id"), ("v", "empty_evidence")}
    with pytest.raises(R.GateError):
        R.gate(R.violations(df, ["instance_id"], R.submission_rules()), "labels")
    R.gate(R.violations(df.where("instance_id = 'task_1'"), ["instance_id"], R.submission_rules()), "labels")


@pytest.mark.parametrize("path,want", [("a/b.pdf", True), ("/a", False), ("../a", False), ("a/../b", False), ("C:\\x", False), ("a..b/c", True), ("", False)])
def test_safe_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(R.is_safe_path(F.col("p"))).first()[0] is want


def test_block_aligned_rates(spark):
    ref = spark.createDataFrame([("d", "b01", "abc"), ("d", "b02", "xyz"), ("d", "b03", "end")], "id string, block_id string, text string")
    seen = spark.createDataFrame([("d", 0, None, "pre"), ("d", 1, "b01", "abd"), ("d", 2, "b01", "again"), ("d", 3, "b03", "end"), ("d", 4, "b09", "q")], "id string, ord int, block_id string, text string")
    row = E.block_aligned(ref, seen).first()
    assert (row.distance, row.length) == (1 + 3 + 3 + 5 + 1, 9)


def test_agreement_and_fidelity_of_empty_sides(spark):
    df = spark.createDataFrame([([], []), (["b01"], []), (["b01", "b02"], ["b02", "b01", "b01"])], "a array<string>, b array<string>")
    ag, fi = E.agreement(F.col("a"), F.col("b")), E.fidelity(F.col("a"), F.col("b"))
    rows = df.select(ag["f1"].alias("f"), ag["exact"].alias("x"), fi["f1"].alias("g"), fi["repeated"].alias("r"), fi["extra"].alias("e")).collect()
    assert [(r.f, r.x) for r in rows] == [(1.0, True), (0.0, False), (1.0, True)]
    assert rows[0].g == 0.0 and rows[2].g == pytest.approx(0.8) and rows[2].r == ["b01"] and rows[2].e == ["b01"]


@pytest.mark.parametrize(
    "question,method,value",
    [
        ("A 10-foot board has 8 marks, each measuring 3 inches. Which percentage is marked?", "percent_of_length", 20.0),
        ("The ratio of 3 parts a to 1 part b gives 56 liters in total.", "ratio_share", 42.0),
        ("It takes 8 minutes to cover every 2 miles and the road is 88 miles long", "constant_rate_coverage", 352.0),
        ("Nothing to compute.", None, None),
        ("The ratio of 0 parts a to 0 parts b gives 56 liters in total.", None, None),
    ],
)
def test_computed_answer(spark, question, method, value):
    m, v = S.computed_answer(F.col("q"))
    row = spark.createDataFrame([(question,)], "q string").select(m.alias("m"), v.alias("v")).first()
    assert (row.m, row.v) == (method, value)


def test_tags_and_severity(spark):
    q = "It moves at a rate of 10 boxes per hour, and each 30-minute interval covers 6. Unrelated words."
    row = spark.createDataFrame([(q,)], "q string").select(S.tags(F.col("q")).alias("t")).select("t", S.severity(F.col("t"), F.lit(False)).alias("s"), S.severity(F.col("t"), F.lit(True)).alias("c")).first()
    assert row.t == ["distractor_operand_interference", "rate_unit_relation_corruption"]
    assert (row.s, row.c) == ("S3", "S4")
    sided = "An eight-sided die is rolled, but since a six-sided die is used instead, what changes?"
    assert spark.createDataFrame([(sided,)], "q string").select(S.tags(F.col("q"))).first()[0] == ["target_or_subquestion_drift"]


def test_shards_are_balanced_and_batches_numbered(spark):
    df = spark.createDataFrame([(f"task_{i:06d}",) for i in range(217)], "id string")
    sizes = sorted(r["count"] for r in P.shards(df, "id", "s", 8).groupBy("shard").count().collect())
    assert sizes == [27] * 7 + [28]
    batches = P.batches(df, "id", "s", 7).collect()
    assert len({r.batch for r in batches}) == 31 and {r.ordinal for r in batches} == set(range(1, 8))


def test_pending_latest_and_consensus(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "id string, fp string")
    done = spark.createDataFrame([("a", "1", "ok"), ("b", "1", "failed"), ("c", "1", "ok")], "id string, fp string, status string")
    todo, stale = P.pending(want, done, "id", "fp")
    assert [r.id for r in todo.collect()] == ["b"] and [r.id for r in stale.collect()] == ["c"]
    tries = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, attempt int, v string")
    assert P.latest(tries, ["id"], "attempt").first().v == "y"
    passes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "z"), ("c", 1, "x")], "id string, pass_no int, d string")
    assert {r.id: r.unanimous for r in P.unanimous(passes, "id", ["d"], 2).collect()} == {"a": True, "b": False, "c": False}


def test_strict_and_lenient_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n[1]\n12 apples\n{"k": 2}\n{"k": ')
    lines = jsonl.numbered_lines(spark, str(tmp_path))
    assert {(r.line_number, r.problem) for r in jsonl.strict_violations(lines).collect()} == {(2, "blank"), (3, "not_an_object"), (4, "invalid"), (6, "invalid")}
    states = {r.line_number: r.state for r in jsonl.lenient(lines, "k int").collect()}
    assert states == {1: "ok", 3: "ok", 4: "bad", 5: "ok", 6: "cut"}


def test_word_table_and_png(spark, tmp_path):
    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", "1\t1\t0\t0\t0\t0\t0\t0\t100\t200\t-1\t", "5\t1\t1\t1\t1\t2\t30\t11\t20\t10\t80\tworld", "5\t1\t1\t1\t1\t1\t5\t10\t20\t10\t90\thello"]
    (tmp_path / "w.tsv").write_text("\n".join(rows))
    line = engines.lines_of_words(engines.word_table(spark, str(tmp_path / "w.tsv"))).first()
    assert (line.text, line.left, line.top, line.right, line.bottom) == ("hello world", 5, 10, 50, 21) and line.confidence == pytest.approx(0.85)
    (tmp_path / "x.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452000000400000002008060000"))
    (tmp_path / "y.png").write_bytes(b"no image at all, but long enough")
    assert {r.file: (r.width, r.height) for r in jsonl.png_sizes(spark, str(tmp_path)).collect()} == {"x.png": (64, 32), "y.png": (None, None)}


def test_observations_and_arrays(spark):
    obs = {"schema_version": "1.0", "image_path": "i", "width": 100, "height": 200, "elapsed_ms": 1.0, "observations": [{"text": "a", "confidence": 0.5, "bbox": {"x": 0.1, "y": 0.025, "width": 0.5, "height": 0.1}}, {"text": "TRAINING COPY", "confidence": 1, "bbox": {"x": 0, "y": 0, "width": 0.9, "height": 0.1}}, {"text": "out", "confidence": 1, "bbox": {"x": 0.9, "y": 0, "width": 0.9, "height": 0.1}}]}
    df = spark.createDataFrame([(json.dumps(obs),), (json.dumps(obs | {"schema_version": "2"}),), ("no json",)], "v string")
    rows = engines.lines_of_observations(df, "v").collect()
    assert [(r.text, r.left, r.top, r.box_width, r.box_height) for r in rows] == [("a", 10, 5, 50, 20)]
    arrays = spark.createDataFrame([("p", ["x"], [0.9], [[1, 2, 11, 22]]), ("q", ["x", "y"], [0.9], [[1, 2, 3, 4]])], "id string, t array<string>, s array<double>, b array<array<int>>")
    rows = engines.lines_of_arrays(arrays, "id", "t", "s", "b").collect()
    assert [(r.id, r.left, r.width, r.height) for r in rows] == [("p", 1, 10, 20)]


def test_sinks(spark, tmp_path):
    with pytest.raises(sinks.LeakError):
        sinks.label_free(spark.createDataFrame([((1,),)], "a struct<answer:int>"))
    sinks.write_json_lines(spark.createDataFrame([("b", None), ("a", "é")], "k string, v string"), str(tmp_path / "o"), ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.splitlines() == ['{"k":"a","v":"é"}', '{"k":"b","v":null}']
    assert sinks.publish(tmp_path / "r.json", b"{}") == sinks.publish(tmp_path / "r.json", b"{}")
    with pytest.raises(FileExistsError):
        sinks.publish(tmp_path / "r.json", b"[]")
    one = sinks.bundle({"b": b"2", "a": b"1"}, tmp_path / "1.tar.gz")
    assert one == sinks.bundle({"a": b"1", "b": b"2"}, tmp_path / "2.tar.gz")
    assert sinks.publish_pair((str(tmp_path / "x"), b"1"), (str(tmp_path / "y"), b"2"))[0] != ""
    assert "| k |" in sinks.markdown(spark.createDataFrame([("a",)], "k string"), "T")
    assert sinks.flat_csv(spark.createDataFrame([([1],)], "a array<int>")).first().a == "[1]"


def test_ingest_resumes_and_keeps_the_last_attempt(spark, tmp_path):
    args = (str(tmp_path / "land"), str(tmp_path / "table"), str(tmp_path / "offsets"), "k int, v string, attempt int", "k", "attempt")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], args[3]).write.mode("append").json(args[0])
    ingest.ingest(spark, *args)
    spark.createDataFrame([(2, "c", 2)], args[3]).write.mode("append").json(args[0])
    ingest.ingest(spark, *args)
    ingest.ingest(spark, *args)
    assert {r.k: r.v for r in ingest.current(spark, args[1]).collect()} == {1: "a", 2: "c"}


def test_every_stored_file_is_in_the_inventory(spark, sf, tmp_path):
    found = {r.file: (r.bytes, r.sha256) for r in QUERIES["file_inventory"](spark, sf).collect()}
    assert found == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(sf).glob("*.parquet")}
    spark.range(20).repartition(2).write.parquet(f"{tmp_path}/a b.parquet")
    spark.range(30).repartition(2).write.parquet(f"{tmp_path}/c.parquet")
    found = {r.file: r.sha256 for r in QUERIES["file_inventory"](spark, str(tmp_path)).collect()}
    assert found == {str(p.relative_to(tmp_path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.rglob("part-*.parquet")}
    assert len(found) == 4


def test_all_records_are_ingested_unchanged(spark, sf):
    names = ["instance_id", "engine"]
    plain = lambda df: sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: [r[n] for n in names])
    stored = spark.read.parquet(f"{sf}/ocr_records.parquet").dropDuplicates(names)
    assert plain(QUERIES["stream_ingest"](spark, sf)) == [r | {"attempt": 2} for r in plain(stored)]


def test_engine_runs_once_per_partition(spark):
    def recognise():
        import pandas as pd

        made = []

        def run(batch):
            made.append(1)
            return pd.DataFrame({"id": batch["id"], "text": "x"})

        return run

    assert B.engine_lines(spark.range(5), recognise, "id long, text string").count() == 5


def test_recovered_queries_are_unique(spark):
    from quillframe.operators import review

    rows = [("a", "b01", "Notes. The desk recorded\nthe  rnatter. What is it?"), ("b", "b01", "nothing"), ("c", "b01", "the desk recorded the matter. x"), ("c", "b02", "The desk recorded the matter. y"), ("d", "b01", None)]
    out = review.recovered_queries(spark.createDataFrame(rows, "id string, block_id string, text string"), ["id"], ["the desk recorded the matter."])
    assert {r.id: (r.status, r.block_id, r.query) for r in out.collect()} == {"a": ("recovered", "b01", "What is it?"), "b": ("no_match", None, None), "c": ("several_matches", None, None), "d": ("no_match", None, None)}


def test_labelled_spans_of_tagged_output(spark):
    from quillframe.operators import review

    text = "<p>b01: a &lt; b</p>\n<|user|><b>B02</b> : c&amp;d b24: no b02: again"
    out = review.html_blocks(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").orderBy("seq").collect()
    assert [(r.block_id, r.text) for r in out] == [("b01", "a < b"), ("b02", "c&d b24: no"), ("b02", "again")]


@pytest.mark.parametrize(
    "row,broken",
    [
        (("run-00001", "42", ["b01"], True, "high"), set()), (("run", "42", ["b01"], True, "0.7"), {"bad_run_id"}), (("run-00001", "4 2", ["b01"], True, "high"), {"bad_answer"}),
        (("run-00001", "42", ["b01"], False, "high"), {"answer_without_uniqueness"}), (("run-00001", None, ["b01"], False, "low"), set()), (("run-00001", "1", ["b01", "b01"], True, "2"), {"bad_evidence", "bad_confidence"}),
        (("run-00001", "1", None, True, None), {"bad_evidence", "bad_confidence"}),
    ],
)
def test_review_rules(spark, row, broken):
    from quillframe.operators import review

    df = spark.createDataFrame([row], "run_id string, answer string, evidence array<string>, unique_answer boolean, confidence string")
    assert {r.rule for r in R.violations(df, ["run_id"], review.review_rules()).collect()} == broken


@pytest.mark.parametrize(
    "row,broken",
    [((["x"], "S2", "aligned"), set()), ((["x"], "S0", "aligned"), {"s0_with_tags"}), (([], "S2", "aligned"), {"tags_without_severity"}), (([], "S2", "semantic_conflict"), {"conflict_below_s4"}), ((["b", "a"], "S9", "odd"), {"unknown_severity", "unknown_alignment", "tags_not_sorted"})],
)
def test_audit_rules(spark, row, broken):
    from quillframe.operators import review

    df = spark.createDataFrame([row], "tags array<string>, severity string, alignment string")
    assert {r.rule for r in R.violations(df, ["severity"], review.audit_rules()).collect()} == broken


def test_command_line(capsys):
    from quillframe.__main__ import main

    assert main(["list"]) == 0 and "eval_micro_cer" in capsys.readouterr().out
    assert main(["run", "no_such_query", "x", "y"]) == 2


@pytest.mark.parametrize("tag", ["rate_unit_relation_corruption", "target_or_subquestion_drift", "comparison_polarity_or_sign", "condition_insertion_or_deletion"])
def test_any_grave_tag_is_s3(spark, tag):
    df = spark.createDataFrame([([tag], False), ([tag, "quantifier_scope_last_remaining"], False), (["quantifier_scope_last_remaining"], False), ([], False), ([], True)], "t array<string>, c boolean")
    assert [r.s for r in df.select(S.severity(F.col("t"), F.col("c")).alias("s")).collect()] == ["S3", "S3", "S2", "S0", "S4"]


@pytest.mark.parametrize(
    "text,reason",
    [("", "empty_output"), ("  \n", "empty_output"), ("b01: " + "a" * 100 + "b" * 100, "valid"), ("x" + "a" * 200, "degenerate_repeated_character"), ("a" * 63, "no_b01_b23_blocks"), ("B23 : x", "valid"), ("b24: x", "no_b01_b23_blocks")],
)
def test_output_reason(spark, text, reason):
    assert spark.createDataFrame([(text,)], "t string").select(B.output_reason(F.col("t"))).first()[0] == reason


def test_reviews_over_a_screen(spark):
    screened = spark.createDataFrame([("a", "S2", ["x"], "aligned", "5"), ("b", "S0", [], "label_unverifiable", None), ("c", "S2", ["x"], "aligned", "5")], "instance_id string, severity string, tags array<string>, alignment string, answer string")
    reviews = spark.createDataFrame([("a", "S0", ["clean"], None, None), ("c", "S3", ["distractor"], "semantic_conflict", "5")], "instance_id string, severity string, tags array<string>, alignment string, value string")
    out = {r.instance_id: (r.severity, r.tags, r.alignment, r.risk, r.disagrees) for r in merge.overlaid(screened, reviews).collect()}
    assert out == {
        "a": ("S0", ["clean"], "aligned", "none", False), "b": ("S0", ["clean"], "label_unverifiable", "none", False),
        "c": ("S3", ["distractor_operand_interference", "x"], "semantic_conflict", "high", True),
    }


def test_a_sound_merge_has_no_violations(spark):
    manifest = spark.createDataFrame([(f"t{i}", i % 2, "q", "s") for i in range(6)], "instance_id string, shard int, user_query string, pdf_sha string")
    results = manifest.withColumn("status", F.lit("ok")).withColumn("configuration", F.lit("c"))
    runs = spark.createDataFrame([(k, 3, 0, False, "1", "m", "r", "s") for k in (0, 1)], "shard int, record_count long, failed_count long, dirty boolean, schema_version string, machine string, revision string, manifest_sha string")
    assert merge.merge_violations(manifest, results, runs, 2).count() == 0
    lost = merge.merge_violations(manifest, results.where("shard = 0"), runs, 2)
    assert {r.rule for r in lost.collect()} == {"missing_id", "shard_missing", "record_count_differs"}
