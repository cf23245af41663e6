"""Problems 6 and 7: packing and mixing."""

import bisect
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import mixing, packing
from quillframe.llm.queries import QUERIES
from quillframe.llm.tokens import sized
from quillframe.session import table

DOC = "doc_id long, source string, text string, tokens int, kind string"


def documents(spark, n=120):
    rng = random.Random(6)
    rows = [(i, rng.choice("aab") if i % 9 else None, " ".join(["word"] * rng.randrange(1, 120)), 5, "k") for i in range(n)]
    rows += [(900, "a", None, 1, "k"), (901, "a", "", 1, "k"), (902, "b", " ".join(["long"] * 1_000), 1, "k"), (903, "c", "tie", 1, "k"), (903, "c", "tie", 1, "k"), (None, "a", "x", 1, "k")]
    return spark.createDataFrame(rows, DOC)


def containers(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "container_kind string, capacity_tokens int, tokens int")


def test_every_document_is_packed_once_and_nothing_overflows(spark):
    docs = documents(spark)
    size = {r.doc_id: r.tokens for r in sized(docs).collect()}
    assert size[900] == 0 and size[901] == 0 and 903 in size and None not in size
    rows = packing.packed(docs, containers(spark, [("small", 128), ("large", 4_096), ("none", 0), (None, 5), ("null", None)])).collect()
    for kind, capacity in (("small", 128), ("large", 4_096)):
        own = [r for r in rows if r.container_kind == kind]
        used, pieces = {}, {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.tokens))
        assert max(used.values()) <= capacity
        assert set(pieces) == set(size)
        for doc, parts in pieces.items():
            assert sum(t for _, t in parts) == size[doc]
            assert [p for p, _ in sorted(parts)] == list(range(max(1, math.ceil(size[doc] / capacity))))
        least = math.ceil(sum(size.values()) / capacity)
        assert least <= len(used) <= math.ceil(least * 1.05) + 1
    assert {r.container_kind for r in rows} == {"small", "large"}


def counted(solution):
    out = Counter()
    for filling, m in solution.items():
        for size, n in filling:
            out[size] += n * m
    return {s: n for s, n in out.items() if n}


def item_by_item(sizes, capacity):
    """Best fit decreasing over single items; the number of bins."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, size)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - size)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_operators_keep_every_item_and_best_fit_is_that_of_single_items(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(0 if seed % 2 else 1, 60) for _ in range(400)]
    items = dict(Counter(sizes))
    plain = packing.best_fit({}, items, 100)
    assert sum(plain.values()) == item_by_item(sizes, 100)
    other = packing.mutate(packing.mutate(plain, 100, rng), 100, rng)
    for made in (plain, other, packing.crossover(plain, other, items, 100, rng), packing.evolve(items, 100, [other], 5, rng)):
        assert counted(made) == items and all(packing.used(f) <= 100 for f in made)
    assert sum(packing.evolve(items, 100, [other], 20, rng).values()) <= sum(plain.values())


def test_evolution_beats_best_fit():
    better = 0
    for seed in range(12):
        rng = random.Random(seed)
        items = dict(Counter(rng.randrange(20, 70) for _ in range(120)))
        plain, found = packing.best_fit({}, items, 150), packing.evolve(items, 150, [], 40, rng)
        assert sum(found.values()) <= sum(plain.values())
        better += sum(found.values()) < sum(plain.values())
    assert better >= 2


def test_sizes_with_very_many_items_are_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    docs = spark.createDataFrame([(i, "a", "" if i % 3 else "one two three", 1, "k") for i in range(90)], DOC)
    rows = packing.packed(docs, containers(spark, [("k", 7)])).collect()
    assert len(rows) == 90 and {r.doc_id for r in rows} == set(range(90))
    used = Counter()
    for r in rows:
        used[r.container_id] += r.tokens
    assert max(used.values()) <= 7 and len(used) == 15


def test_number_of_generations_is_the_same_for_every_input(monkeypatch):
    calls = []
    monkeypatch.setattr(packing, "crossover", lambda giver, taker, *_: (calls.append(1), taker)[1])
    # Sizes of which three fit together and no two are the same, so the bound is never reached.
    for n in (30, 60_000):
        calls.clear()
        packing.evolve(dict.fromkeys(range(260_000, 260_000 + n), 1), 1_000_000, [], 10, random.Random(1))
        assert len(calls) == 10 * (packing.POPULATION - 2)


def test_containers_are_the_same_with_and_without_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a", "" if i % 3 else "one two three", 1, "k") for i in range(90)], DOC)
    found = []
    for most in (7, 29, 100_000):
        monkeypatch.setattr(packing, "RANKED", most)
        found.append(sorted(map(tuple, packing.packed(docs, containers(spark, [("k", 7)])).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 90


def test_packing_of_empty_tables(spark):
    docs = documents(spark)
    assert packing.packed(docs.where("1 = 0"), containers(spark, [("a", 10)])).count() == 0
    assert packing.packed(docs, containers(spark, [("a", 10)]).where("1 = 0")).count() == 0


def test_packing_never_needs_more_than_best_fit_over_all_documents(spark, sf):
    docs, kinds = table(spark, sf, "documents"), table(spark, sf, "containers")
    tokens = [r.tokens for r in sized(docs).collect()]
    for r in packing.packing_report(packing.Packing(docs, kinds), kinds).collect():
        pieces = [t % r.capacity_tokens for t in tokens if t % r.capacity_tokens or not t]
        whole = sum(t // r.capacity_tokens for t in tokens)
        assert r.least_possible <= r.n_containers <= r.best_fit == item_by_item(pieces, r.capacity_tokens) + whole


def targets(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "mix_id string, source string, target_weight double, max_repeats int, text string")


def test_mix_reaches_its_shares_under_the_caps(spark):
    docs = documents(spark, 900)
    rows = [("m", "a", 3.0, 2), ("m", "b", 1.0, 5), ("m", "nobody", 1.0, 5), ("m", "c", None, None), ("o", "b", 0.5, None), ("o", "c", 0.0, 3), ("o", None, 1.0, 1), (None, "a", 1.0, 1)]
    mix = mixing.mixed(docs, targets(spark, rows)).collect()
    assert {(r.mix_id, r.source) for r in mix} == {("m", "a"), ("m", "b"), ("o", "b")}
    most = {}
    for r in mix:
        most[r.mix_id, r.source] = max(most.get((r.mix_id, r.source), 0), r.copy)
    assert most["m", "a"] <= 2 and most["m", "b"] <= 5 and most["o", "b"] == 1
    share = {(r.mix_id, r.source): r for r in mixing.shares(docs, targets(spark, rows)).collect()}
    assert share["m", "a"].actual_share == pytest.approx(0.75, abs=0.01)
    assert share["m", "nobody"].actual_share == 0.0 and share["m", "nobody"].target_share == 0.2
    again = mixing.mixed(docs, targets(spark, rows)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mix))


def test_mix_of_empty_tables(spark):
    docs = documents(spark)
    rows = targets(spark, [("m", "a", 1.0, 1)])
    assert mixing.mixed(docs.where("1 = 0"), rows).count() == 0
    assert mixing.mixed(docs, rows.where("1 = 0")).count() == 0


def test_inverse_of_the_poisson_distribution():
    u = (np.arange(100_000) + 0.5) / 100_000
    n = mixing._copies(1.3, 50, u)
    assert n.mean() == pytest.approx(1.3, abs=1e-3) and n.var() == pytest.approx(1.3, abs=1e-2)
    assert mixing._copies(9.0, 2, u).max() == 2
    assert mixing.solve_mean(np.ones(4_096), 4_096 * 3.0, 3) == math.inf


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("mean", [0.3, 30.0, 900.0, 20_000.0])
def test_copies_of_any_mean_have_the_moments_of_its_distribution(mean):
    u = (np.arange(200_000) + 0.5) / 200_000
    n = mixing._copies(mean, 10**6, u)
    assert n.mean() == pytest.approx(mean, rel=1e-3) and n.var() == pytest.approx(mean, rel=1e-2)
    assert len(mixing.poisson(mean, 10**6)[1]) < 24 * math.sqrt(mean) + 100


def test_caps_beyond_a_thousand_are_kept(spark):
    docs = spark.createDataFrame([(1, "a", "one two", 1, "k")] + [(i, "b", "word " * 400, 1, "k") for i in range(2, 40)], DOC)
    mix = mixing.mixed(docs, targets(spark, [("m", "a", 1.0, 5_000), ("m", "b", 1.0, 1)]))
    most = {r.source: (r.n, r.most) for r in mix.groupBy("source").agg(F.count("*").alias("n"), F.max("copy").alias("most")).collect()}
    assert 1_000 < most["a"][1] <= 5_000 and most["b"][1] == 1


def test_more_kinds_of_containers_than_a_thousand(spark):
    docs = spark.createDataFrame([(1, "a", "one two", 1, "k")], DOC)
    kinds = spark.range(1_200).select(F.concat(F.lit("k"), "id").alias("container_kind"), F.lit(8).alias("capacity_tokens"))
    assert packing.packed(docs, kinds).select("container_kind").distinct().count() == 1_200
