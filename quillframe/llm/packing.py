"""Problem 6: filling fixed-capacity containers with items.

Method: a grouping genetic algorithm over classes of equal items.  Items of one size are interchangeable and sizes are
whole numbers up to the capacity, so the whole input is a histogram with at most ``capacity`` entries however many
documents there are, and a solution is a list of groups: a filling (sizes and how many of each) and the number of bins
filled that way.  Crossover injects well-filled groups of one parent into the other, takes out the bins that now hold
duplicates, and places the displaced items by best fit; mutation dissolves the emptiest bins.  Every kind of container
evolves on several islands, one task each; after each round an island gets the elite of its neighbour.  One individual of
every island starts from best fit over all items, so the result never needs more bins than that.

The solution is then applied in one pass: items of a size are numbered, hot sizes in buckets, and their number tells the bin.
A document larger than the capacity fills whole containers with all but its last piece.
"""

from __future__ import annotations

import bisect
import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import cut, name_free
from quillframe.llm.tokens import VOCABULARY, sized

ISLANDS = 4
ROUNDS = 3
GENERATIONS = 10
POPULATION = 6
#: Items of one size that are numbered in one bucket.
RANKED = 100_000

#: A filling, largest size first: (size, how many) per size.
Filling = tuple[tuple[int, int], ...]
#: How many bins have which filling.
Solution = dict[Filling, int]


def used(filling: Filling) -> int:
    tokens = 0
    for size, n in filling:
        tokens += size * n
    return tokens


def merged(filling: Filling, size: int, n: int) -> Filling:
    """The filling with ``n`` more items of ``size``."""
    if not filling or filling[-1][0] > size:
        return (*filling, (size, n))
    out = dict(filling)
    out[size] = out.get(size, 0) + n
    return tuple(sorted(out.items(), reverse=True))


def best_fit(start: Solution, items: dict[int, int], capacity: int) -> Solution:
    """Place ``items`` (number by size), largest first, each into the fullest bin with room."""
    rooms: dict[int, list[tuple[Filling, int]]] = {}
    for filling, m in start.items():
        rooms.setdefault(capacity - used(filling), []).append((filling, m))
    order = sorted(rooms)

    def put(filling: Filling, room: int, m: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((filling, m))

    for size in sorted((s for s, n in items.items() if n > 0), reverse=True):
        n = items[size]
        while n:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                each = capacity // size if size else n
                bins, rest = divmod(n, each)
                if bins:
                    put(((size, each),), capacity - each * size, bins)
                if rest:
                    put(((size, rest),), capacity - rest * size, 1)
                break
            room = order[at]
            filling, m = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            each = room // size if size else n
            bins = min(m, n // each)
            if bins:
                put(merged(filling, size, each), room - each * size, bins)
                n, m = n - bins * each, m - bins
            elif n:
                put(merged(filling, size, n), room - n * size, 1)
                n, m = 0, m - 1
            if m:
                put(filling, room, m)
    out: Counter[Filling] = Counter()
    for groups in rooms.values():
        for filling, m in groups:
            out[filling] += m
    return dict(out)


def bound(items: dict[int, int], capacity: int) -> int:
    """Bins that no solution can do without: all tokens together, and items of which no two fit together."""
    return max(math.ceil(sum(s * n for s, n in items.items()) / capacity), sum(n for s, n in items.items() if 2 * s > capacity), 1 if items else 0)


def fitness(solution: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly: full ones and one with the rest."""
    return -sum(solution.values()), sum(m * (used(f) / capacity) ** 2 for f, m in solution.items())


def _some(m: int, share: float, rng: random.Random) -> int:
    return int(m * share + rng.random())


def crossover(giver: Solution, taker: Solution, items: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    left = dict(items)
    out: Counter[Filling] = Counter()
    ranked = sorted(giver.items(), key=lambda g: (used(g[0]), g[0]), reverse=True)
    wanted = max(1, sum(giver.values()) // 2)
    for filling, m in ranked:
        if wanted <= 0:
            break
        m = min(m, wanted)
        wanted -= m
        if m := _some(m, 0.7, rng):
            out[filling] += m
            for size, n in filling:
                left[size] -= n * m
    rest = list(taker.items())
    rng.shuffle(rest)
    for filling, m in rest:
        # A bin stays if none of its items is in an injected one.
        keep = m
        for size, n in filling:
            if left[size] < n * keep:
                keep = left[size] // n
        if keep:
            out[filling] += keep
            for size, n in filling:
                left[size] -= n * keep
    return best_fit(dict(out), left, capacity)


def mutate(solution: Solution, capacity: int, rng: random.Random) -> Solution:
    ranked = sorted(solution.items(), key=lambda g: (used(g[0]), g[0]))
    gone = max(2, sum(solution.values()) // 12)
    loose: Counter[int] = Counter()
    kept: Counter[Filling] = Counter()
    for filling, m in ranked:
        out = min(m, gone)
        gone -= out
        if not out:
            out = _some(m, 0.04, rng)
        for size, n in filling:
            loose[size] += n * out
        if m - out:
            kept[filling] += m - out
    return best_fit(dict(kept), loose, capacity)


def evolve(items: dict[int, int], capacity: int, seeds: list[Solution], generations: int, rng: random.Random) -> Solution:
    """The best solution an island finds from best fit, shuffled starts and the elites it was given."""
    least = bound(items, capacity)

    def rated(solution: Solution) -> tuple[tuple[int, float], Solution]:
        return fitness(solution, capacity), solution

    def rate(member: tuple[tuple[int, float], Solution]) -> tuple[int, float]:
        return member[0]

    # Every solution is rated once, when it is made.
    pool = [rated(s) for s in (*seeds, best_fit({}, items, capacity))]
    while len(pool) < POPULATION and -max(map(rate, pool))[0] > least:
        head = {s: min(n, _some(n, 0.35, rng)) for s, n in items.items()}
        pool.append(rated(best_fit(best_fit({}, head, capacity), {s: n - head[s] for s, n in items.items()}, capacity)))
    for _ in range(generations):
        pool.sort(key=rate, reverse=True)
        if -rate(pool[0])[0] <= least:
            break
        children = []
        for k in range(POPULATION - 2):
            giver, taker = pool[0] if k % 2 else rng.choice(pool), rng.choice(pool)
            child = crossover(giver[1], taker[1], items, capacity, rng)
            children.append(rated(mutate(child, capacity, rng) if rng.random() < 0.5 else child))
        pool = pool[:2] + children
    return max(pool, key=rate)[1]


_ELITE = "kind string, island int, m array<int>, width array<int>, size array<int>, n array<int>"


def _packed_row(kind: str, island: int, solution: Solution) -> tuple:
    return kind, island, list(solution.values()), [len(f) for f in solution], [s for f in solution for s, _ in f], [n for f in solution for _, n in f]


def _solution(m: list[int], width: list[int], size: list[int], n: list[int]) -> Solution:
    out, at = {}, 0
    for bins, w in zip(m, width):
        out[tuple(zip(size[at : at + w], n[at : at + w]))] = bins
        at += w
    return out


def solved(spark, items: dict[str, dict[int, int]], capacities: dict[str, int]) -> dict[str, Solution]:
    """The best solution of every kind: ``ROUNDS`` rounds on ``ISLANDS`` islands, with migration in a ring after each.

    What travels is bounded by the capacities: a histogram or a solution per island, not items.
    """
    kinds = sorted(items)
    best = {k: best_fit({}, items[k], capacities[k]) for k in kinds}
    elites: dict[tuple[str, int], Solution] = {}
    for turn in range(ROUNDS):
        busy = [k for k in kinds if sum(best[k].values()) > bound(items[k], capacities[k])]
        if not busy:
            break

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in _ELITE.split(", ")]
            for batch in batches:
                per: dict[tuple[str, int], list[Solution]] = {}
                for kind, island, *parts in zip(*(batch.column(c).to_pylist() for c in names)):
                    own = per.setdefault((kind, island), [])
                    if parts[0]:
                        own.append(_solution(*parts))
                for (kind, island), seeds in per.items():
                    found = evolve(items[kind], capacities[kind], seeds, GENERATIONS, random.Random(f"{kind}:{island}:{turn}"))
                    row = _packed_row(kind, island, found)
                    types = [pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        state = []
        for kind in busy:
            for island in range(ISLANDS):
                seeds = [s for i in (island, (island + 1) % ISLANDS) if (s := elites.get((kind, i))) is not None]
                state += [_packed_row(kind, island, s) for s in seeds or [{}]]
        islands = spark.createDataFrame(state, _ELITE).repartition(len(busy) * ISLANDS, "kind", "island").sortWithinPartitions("kind", "island")
        for r in islands.mapInArrow(run, _ELITE).collect():
            elites[r.kind, r.island] = _solution(r.m, r.width, r.size, r.n)
            best[r.kind] = max(best[r.kind], elites[r.kind, r.island], key=lambda s: fitness(s, capacities[r.kind]))
    return best


def places(solution: Solution) -> np.ndarray:
    """(size, first number, first bin, items a bin) of every run of equal items, sorted by size and number."""
    rows, taken, base = [], Counter(), 0
    for filling, m in sorted(solution.items(), reverse=True):
        for size, n in filling:
            rows.append((size, taken[size], base, n))
            taken[size] += n * m
        base += m
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


class Packing:
    """All documents in containers: ``assigned`` (container_kind, container_id, doc_id, piece, tokens), and per kind the
    number of containers best fit alone would need (``best_fit``)."""

    def __init__(self, documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> None:
        spark = documents.sparkSession
        wanted = name_free(containers, "container_kind", "capacity_tokens").where("container_kind IS NOT NULL AND capacity_tokens > 0")
        # One row for each kind: a list of settings, not data that grows.
        rows = wanted.groupBy("container_kind").agg(F.max("capacity_tokens").alias("c")).collect()
        capacities = {r[0]: int(r[1]) for r in sorted(rows)}
        self.best_fit: dict[str, int] = {}
        if not capacities:
            self.assigned = spark.createDataFrame([], "container_kind string, container_id string, doc_id long, piece int, tokens long")
            return
        sizes = cut(sized(documents, vocabulary).select("doc_id", "tokens"))
        options = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity")) for k, c in capacities.items()])
        each = sizes.select("doc_id", "tokens", F.inline(options))
        whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
        full = each.where("tokens >= capacity").select("kind", "doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), F.col("capacity").cast("long").alias("tokens"))
        rest = each.select("kind", "doc_id", whole.alias("piece"), (F.col("tokens") % F.col("capacity")).alias("tokens")).where("tokens > 0 OR piece = 0")
        # At most ``capacity`` counts for a kind.
        items: dict[str, dict[int, int]] = {}
        for kind, tokens, n in rest.groupBy("kind", "tokens").count().collect():
            items.setdefault(kind, {})[int(tokens)] = n
        filled = {r[0]: r[1] for r in full.groupBy("kind").count().collect()}
        solution = solved(spark, items, capacities)
        for kind in capacities:
            plain = sum(best_fit({}, items.get(kind, {}), capacities[kind]).values())
            self.best_fit[kind] = plain + filled.get(kind, 0)
        table = {k: places(s) for k, s in solution.items()}
        numbered = _numbered(rest, items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = np.array(batch.column("kind").to_pylist(), object)
                size, number = batch.column("tokens").to_numpy(), batch.column("number").to_numpy()
                ids = np.empty(len(kind), object)
                for k in set(kind):
                    own = np.nonzero(kind == k)[0]
                    t = table[k]
                    at = _find(t, size[own], number[own])
                    bins = t[at, 2] + (number[own] - t[at, 1]) // t[at, 3]
                    ids[own] = [f"b-{b}" for b in bins.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(ids, pa.string()), *[batch.column(c) for c in ("doc_id", "piece", "tokens")]], ["container_kind", "container_id", "doc_id", "piece", "tokens"])

        placed = numbered.mapInArrow(run, "container_kind string, container_id string, doc_id long, piece int, tokens long")
        alone = full.select(F.col("kind").alias("container_kind"), F.format_string("w-%d-%d", "doc_id", "piece").alias("container_id"), "doc_id", "piece", "tokens")
        self.assigned = alone.unionByName(placed)


def _find(t: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The row of ``t`` (sorted by size and first number) that holds each (size, number)."""
    low, high = np.searchsorted(t[:, 0], size, "left"), np.searchsorted(t[:, 0], size, "right")
    while (wide := high - low > 1).any():
        mid = (low + high) // 2
        right = wide & (t[np.minimum(mid, len(t) - 1), 1] <= number)
        low = np.where(right, mid, low)
        high = np.where(wide & ~right, mid, high)
    return low


def _numbered(rest: DataFrame, items: dict[str, dict[int, int]]) -> DataFrame:
    """``rest`` with the number of every item among those of its kind and size, in the order of a hash; sizes with very
    many items are numbered in buckets, ranges of the hash whose sizes are then added up, to the same numbers."""
    spark = rest.sparkSession
    hot = [(k, s, math.ceil(n / RANKED)) for k, own in items.items() for s, n in own.items() if n > RANKED]
    order = Window.partitionBy("kind", "tokens", "bucket").orderBy("hash", "doc_id")
    # 31 bits of the hash tell the bucket, so that its product with the number of buckets stays exact.
    rest = rest.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    if not hot:
        return rest.withColumn("bucket", F.lit(0)).withColumn("number", F.row_number().over(order).cast("long") - 1).drop("bucket", "hash")
    # At most one row for each size of a kind.
    buckets = F.broadcast(spark.createDataFrame(hot, "kind string, tokens long, buckets int"))
    bucket = F.shiftright(F.shiftright("hash", 32) * F.coalesce("buckets", F.lit(1)), 31)
    dealt = rest.join(buckets, ["kind", "tokens"], "left").withColumn("bucket", bucket)
    counts = dealt.where("buckets IS NOT NULL").groupBy("kind", "tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("kind", "tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = dealt.withColumn("number", F.row_number().over(order).cast("long") - 1).join(offset, ["kind", "tokens", "bucket"], "left")
    return joined.select("kind", "doc_id", "piece", "tokens", (F.col("number") + F.coalesce("offset", F.lit(0))).alias("number"))


def packed(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens): the container of every document or piece of one.

    A null or empty text has no tokens and still gets a container; repeated document rows count once; containers
    without a positive capacity hold nothing; extra columns are ignored; an empty table gives an empty result.
    """
    return Packing(documents, containers, vocabulary).assigned


def packing_report(packing: Packing, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_containers, best_fit, least_possible, tokens, fill) per kind; ``best_fit`` is
    the number plain best fit over all documents needs."""
    spark = containers.sparkSession
    size = name_free(containers, "container_kind", "capacity_tokens").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    plain = spark.createDataFrame(sorted(packing.best_fit.items()), "container_kind string, best_fit long")
    per = packing.assigned.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("used")).groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("used").alias("tokens"))
    out = per.join(F.broadcast(size), "container_kind").join(F.broadcast(plain), "container_kind")
    return out.select(
        "container_kind", "capacity_tokens", "n_containers", "best_fit", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_possible"), "tokens",
        F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )
