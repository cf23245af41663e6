"""Problems 2 and 5: similar queries and cross-split overlaps against brute force, and odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import graph, neardup, overlap, setjoin
from quillframe.llm.common import salted_join
from quillframe.session import table

SCHEMA = "instance_id string, user_query string, document_pdf string, split string, source string, text string, set_id string"
WORD = re.compile(r"[^\W_]+")


def word_set(q):
    return set(WORD.findall(q.lower()))


def tasks(spark, rows):
    """Rows of (id, query, path, split) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, "s", "x", "y") for r in rows], SCHEMA)


def brute(rows):
    by = [(i, word_set(q)) for i, q in {(r[0], r[1]) for r in rows if r[0] and r[1]}]
    by = [(i, w) for i, w in by if len(w) >= 12]
    return {tuple(sorted((a, b))) for k, (a, x) in enumerate(by) for b, y in by[k + 1 :] if a != b and len(x & y) / len(x | y) >= 0.75}


def made(seed, n=250):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "한국어", "Straße"]
    rows, base = [], []
    for k in range(n):
        if base and rng.random() < 0.5:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))]
        base.append(words)
        rows.append((f"t{k:04d}", " ".join(words), None, rng.choice(["train", "val", "test"])))
    return rows


def pairs(df):
    return {(r.instance_id_a, r.instance_id_b) for r in df.collect()}


@pytest.mark.parametrize("limit", [20_000, 20, 3])
def test_similar_sets_match_brute_force_at_every_list_limit(spark, limit):
    rows = made(limit)
    sets = neardup.query_sets(tasks(spark, rows))
    links = setjoin.similar_sets(sets, 0.75, limit)
    assert pairs(neardup.members_to_pairs(links, sets.select("id", "set_id").distinct())) == brute(rows)


def listed(sets):
    """Sizes, positions and signatures of a list of sets of bit numbers."""
    bits = np.zeros((len(sets), setjoin.SIGNATURE_BITS), np.uint8)
    for i, s in enumerate(sets):
        bits[i, sorted(s)] = 1
    return np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64), np.packbits(bits, axis=1).view(np.uint64)


def test_derived_answers_keep_pairs_at_the_bound_of_a_smaller_size():
    leader, other = set(range(12)), set(range(11, 23))
    last = set(range(12, 25))  # 3 words from ``other`` (sizes 12 and 13), 25 from the leader
    found = {tuple(sorted(p)) for i, j in setjoin.compare_list(*listed([leader] * 12 + [other, last]), 0.75) for p in zip(i.tolist(), j.tolist())}
    assert len(other & last) / len(other | last) >= 0.75 and (12, 13) in found


def test_similar_pairs_on_the_stored_table(spark, sf):
    rows = [(r.instance_id, r.user_query) for r in table(spark, sf, "tasks").select("instance_id", "user_query").collect()]
    assert pairs(neardup.similar_pairs(table(spark, sf, "tasks"))) == brute(rows)


LONG = "one two three four five six seven eight nine ten eleven twelve"


def odd_rows():
    return [
        ("a", LONG, "train/x-1.pdf", "train"), ("a", LONG, "train/x-1.pdf", "train"), ("b", LONG.upper(), "val/x-2.pdf", "val"),
        ("c", None, None, None), (None, LONG, "train/x.pdf", "train"), ("d", "", "", "test"), ("e", "one two", "train/q.pdf", "train"), ("f", "one two", "test/r.pdf", "test"),
        ("g", " ".join(f"w{i}" for i in range(20_000)), None, "train"), ("h", " ".join(f"w{i}" for i in range(19_000)), None, "validation"),
    ]


def test_odd_inputs(spark):
    df = tasks(spark, odd_rows())
    assert pairs(neardup.similar_pairs(df)) == {("a", "b"), ("g", "h")}
    assert pairs(overlap.cross_split_pairs(df)) == {("a", "b"), ("g", "h")}
    groups = {r.instance_id: r for r in neardup.similar_groups(df).collect()}
    assert groups["a"].group_id == groups["b"].group_id and groups["a"].group_size == 2 and groups["g"].n_links == 1


def test_empty_tables(spark):
    empty = tasks(spark, [("a", "b", "c", "train")]).where("1 = 0")
    assert pairs(neardup.similar_pairs(empty)) == set()
    assert pairs(overlap.cross_split_pairs(empty)) == set()
    assert neardup.similar_groups(empty).count() == 0
    assert overlap.shared_spans(empty).count() == 0


def test_a_third_of_the_rows_may_be_copies(spark):
    rows = [(f"c{i:03d}", LONG, None, "train" if i % 2 else "test") for i in range(60)] + [(r[0], r[1], None, r[3]) for r in made(1, 120)]
    assert pairs(neardup.similar_pairs(tasks(spark, rows))) == brute(rows)


@pytest.mark.parametrize("limit", [20_000, 4, 2, 1])
def test_cross_split_pairs_and_files_match_brute_force(spark, limit):
    rows = [(i, q, f"{s}/d{k % 60}.pdf" if k % 3 else None, s) for k, (i, q, _, s) in enumerate(made(5))]
    side = {r[0]: "train" if r[3] == "train" else "eval" for r in rows}
    want = {p for p in brute(rows) if side[p[0]] != side[p[1]]}
    name = {r[0]: (r[2] or "/").split("/")[1] for r in rows}
    want |= {(a, b) for a in name for b in name if a < b and name[a] and name[a] == name[b] and side[a] != side[b]}
    assert pairs(overlap.cross_split_pairs(tasks(spark, rows), list_limit=limit)) == want


@pytest.mark.parametrize("t,least", [(0.75, 12), (0.75, 1), (0.8, 5), (0.5, 3), (0.9, 12)])
def test_similar_sets_share_a_span_within_reach(t, least):
    rng = random.Random(3)
    depth = overlap.guaranteed(t, least)
    seen = 0
    while seen < 300:
        x = set(rng.sample(range(1_000), rng.randrange(least, 40)))
        y = set(x)
        for _ in range(rng.randrange(1, 12)):
            if rng.random() < 0.5 and y:
                y.discard(rng.choice(sorted(y)))
            else:
                y.add(rng.randrange(1_000))
        if x == y or len(y) < least or len(x & y) / len(x | y) < t:
            continue
        seen += 1
        spans = [{tuple(w[i : i + depth]) for i in range(int(overlap.reach(np.array([len(w)]), depth, t)[0]) + 1)} for w in (sorted(x), sorted(y))]
        assert spans[0] & spans[1], (sorted(x), sorted(y))
    assert overlap.guaranteed(0.75, 12) == 3


@pytest.mark.parametrize("limit", [20_000, 2])
def test_shared_spans_match_brute_force(spark, limit):
    rows = made(9, 120)
    train = {tuple(w[i : i + 5]) for r in rows if r[3] == "train" for w in [r[1].lower().split()] for i in range(len(w) - 4)}
    want = {}
    for i, q, _, s in rows:
        if s != "train":
            w = q.lower().split()
            want[i] = len({p + k for p in range(len(w) - 4) if tuple(w[p : p + 5]) in train for k in range(5)})
    assert {r.instance_id: r.n_covered for r in overlap.shared_spans(tasks(spark, rows), 5, limit).collect()} == want


def test_a_file_with_many_copies_on_both_sides(spark):
    rows = [(f"{s}{i:03d}", None, f"{s}/one.pdf", s) for s in ("train", "val") for i in range(30)]
    left = spark.createDataFrame([(i, "k") for i in range(50)] + [(99, None)], "x int, key string")
    right = spark.createDataFrame([(i, "k") for i in range(7)], "y int, key string")
    assert salted_join(left, right, "key", 4).distinct().count() == 350
    assert overlap.cross_split_pairs(tasks(spark, rows)).count() == 900


@pytest.mark.parametrize("t", [0.75, 0.5, 0.34])
def test_small_sets_match_brute_force_when_their_words_are_hot(spark, t):
    rng = random.Random(11)
    kept = {frozenset(rng.sample("abcdefghi", rng.choice([1, 1, 2, 2, 3, 4, 5]))) for _ in range(120)}
    named = {" ".join(sorted(w)): w for w in kept}
    sets = setjoin.distinct_sets(spark.createDataFrame([(k, sorted(w)) for k, w in named.items()], "id string, words array<string>"), "id", "words", 1)
    name = {r.set_id: r.id for r in sets.collect()}
    found = {tuple(sorted((name[r.a], name[r.b]))) for r in setjoin.similar_sets(sets, t, 3).collect()}
    assert found == {(a, b) for a, x in named.items() for b, y in named.items() if a < b and len(x & y) / len(x | y) >= t - 1e-12}


@pytest.mark.parametrize(
    "path,name",
    [
        ("train/documents/tea-crates-silo-20978.pdf", "tea-crates-silo-20978"), ("./val/documents/Tea_Crates_Silo_20978.PDF", "tea-crates-silo-20978"),
        ("train\\documents\\tea crates silo 20978.pdf.pdf", "tea-crates-silo-20978"), ("a/tea%20crates%20silo%2020978.Pdf", "tea-crates-silo-20978"),
        ("a/tea-crates-silo-20978 (1).pdf", "tea-crates-silo-20978"), ("a/tea-crates-silo-20978-copy.PDF", "tea-crates-silo-20978"),
        ("a/tea-crates-silo-20978_copy.pdf.pdf", "tea-crates-silo-20978"), ("a/tea-crates-silo-20978 - Copy.pdf", "tea-crates-silo-20978"),
        ("a/tea-crates-silo-20979.pdf", "tea-crates-silo-20979"), ("", None), (None, None), ("100%.pdf", "100"),
    ],
)
def test_canonical_file(spark, path, name):
    assert spark.createDataFrame([(path,)], "p string").select(overlap.canonical_file(F.col("p"))).first()[0] == name


def test_files_and_splits(spark):
    rows = [("a", None, "train/d/x-1.pdf", None), ("b", None, "val\\d\\X_1 (2).PDF", None), ("c", None, "test/d/x-2.pdf", "test"), ("d", None, "elsewhere/x-1.pdf", None), ("e", None, "./test/x-1-copy.pdf", None)]
    df = tasks(spark, rows)
    found = overlap.cross_split_pairs(df)
    assert pairs(found) == {("a", "b"), ("a", "e")}
    report = {(r.split_name, r.source): (r.n_tasks, r.n_overlapping, r.n_pairs) for r in overlap.overlap_report(df, found).collect()}
    assert report == {("validation", "s"): (1, 1, 1), ("test", "s"): (2, 1, 1)}


def test_shared_spans_cover_words(spark):
    rows = [("t", "p q one two three four five six z", None, "train"), ("v", "a one two three four five six b c d", None, "val"), ("w", "four five", None, "test"), ("n", None, None, "test")]
    out = {r.instance_id: (r.n_words, r.n_covered, r.coverage) for r in overlap.shared_spans(tasks(spark, rows), 5).collect()}
    assert out == {"v": (10, 6, 0.6), "w": (2, 0, 0.0), "n": (0, 0, 0.0)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    out = {r.v: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {v: root(v) for v in parent}
