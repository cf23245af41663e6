"""Problem 8: garbled text from wrong character encoding.

Method: every source is a channel that may have swapped code pages.  A swap (page the bytes were read with, page they
were written in) is a substitution cipher from the characters seen to the letters meant; of multi-byte pages, from
sequences.  Which ciphers a source uses, and which letter each of its characters stands for, is unknown and learned by
expectation-maximisation.  The E-step scores each run of non-ASCII characters under every swap by the character bigrams
of the corpus, in the context of its neighbours, and weighs it by what the source's present table says; the M-step counts
again, per source, the swaps and the table from characters to letters.  The most likely reading of each run is then
applied as a translation of its characters.  Code pages only say which letters a character may stand for: a table free of
any code page cannot be told from noise on short runs.

The texts are read twice.  The first pass counts bigrams and the distinct runs with their neighbours, by source; all scores
and all rounds of learning read this table of runs, and the bigrams are re-estimated from it as well.  The second pass
finds the places of the runs that turned out garbled.

Replacement signs are damage that nothing restores.  They are no case where the text only names the sign: alone between
two words, in a slot where the corpus never has another non-ASCII character; nor is any sequence a case that stands
alone between quotation marks.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import cut, name_free, once

#: Pages with which bytes may have been read wrongly, and pages in which they may have been written.
READ_WITH = ("cp1252", "latin_1", "mac_roman", "cp1250", "cp1251", "cp850", "cp437", "cp949", "cp1254", "cp1253", "cp1257", "iso8859_2", "iso8859_15", "koi8_r", "cp852", "cp866", "mac_latin2", "gbk", "big5", "cp932")
WRITTEN_IN = ("utf_8", "cp1252", "cp949", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r")
_MANY_BYTES = {"cp949", "gbk", "big5", "cp932"}
SWAPS = [(r, w) for w in WRITTEN_IN for r in READ_WITH if r != w]
TWICE = [(r, "utf_8", 2) for r in ("cp1252", "latin_1", "mac_roman", "cp850", "cp1250", "cp1251", "cp437")]
#: Number 0 is no swap; then the single swaps, then the double ones.
LABELS = ["none", *[f"{r}>{w}" for r, w in SWAPS], *[f"{r}>{w}x2" for r, w, _ in TWICE]]

_OF_PAGE = {page: [(i, w) for i, (r, w) in enumerate(SWAPS, 1) if r == page] for page in READ_WITH}

SKETCH = 1 << 20
ROUNDS = 3
UNSEEN = 0.02
#: Sources beyond this many share their swap frequencies with others, by a hash; it bounds what the driver holds.
CHANNELS = 4_096
#: Prior share of a swap in a source before any round.
START = 1e-5
RUN = re.compile(r"[^\x00-\x7f]+")
SIGN = "�"
_QUOTES = ("“\"'«‘‹„`(", "”\"'»’›“`)")


@functools.cache
def _byte_of(page: str) -> dict[str, int]:
    """Bytes by character; bytes a page leaves undefined read as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _bytes(text: str, page: str) -> bytes | None:
    if page in _MANY_BYTES:
        try:
            return text.encode(page)
        except UnicodeEncodeError:
            return None
    table = _byte_of(page)
    out = bytearray()
    for char in text:
        b = table.get(char)
        if b is None:
            if ord(char) > 127:
                return None
            b = ord(char)
        out.append(b)
    return bytes(out)


def _unswap(text: str, read: str, written: str) -> str | None:
    data = _bytes(text, read)
    if data is None:
        return None
    try:
        out = data.decode(written)
    except UnicodeDecodeError:
        return None
    return None if out == text else out


def units(run: str, meant: str, number: int) -> list[tuple[str, str]]:
    """(characters seen, letter meant) of a reading; one unit where a page reads several bytes as one character."""
    read, written = (SWAPS[number - 1] if number <= len(SWAPS) else TWICE[number - 1 - len(SWAPS)][:2]) if number else ("", "")
    if not number or number > len(SWAPS) or read in _MANY_BYTES:
        return [(run, meant)] if number else [(c, c) for c in run]
    out, at = [], 0
    for letter in meant:
        wide = len(letter.encode(written))
        out.append((run[at : at + wide], letter))
        at += wide
    return out if at == len(run) else [(run, meant)]


@functools.lru_cache(1 << 16)
def readings(run: str) -> tuple[tuple[int, str], ...]:
    """(swap number, text meant) of every swap that could have made ``run``."""
    out = []
    for page in READ_WITH:
        data = _bytes(run, page)
        if data is None or data.isascii():
            continue
        for number, written in _OF_PAGE[page]:
            try:
                text = data.decode(written)
            except UnicodeDecodeError:
                continue
            if text != run:
                out.append((number, text))
    out.sort()
    if not out:
        return ()
    for i, (r, w, _) in enumerate(TWICE, 1 + len(SWAPS)):
        once = _unswap(run, r, w)
        # The second reading may have been with a page of the same family.
        for other in dict.fromkeys((r, "cp1252", "latin_1")):
            if once and (again := _unswap(once, other, w)) is not None:
                out.append((i, again))
                break
    return tuple(out)


def _slots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)
        x *= np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(44)).astype(np.int64), ((x >> np.uint64(20)) & np.uint64(SKETCH - 1)).astype(np.int64)


def _slot(a: int, b: int) -> tuple[int, int]:
    """:func:`_slots` of one bigram."""
    x = (((a << 21) | b) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return x >> 44, (x >> 20) & (SKETCH - 1)


class Bigrams:
    """Character bigrams of the corpus as a count-min sketch: two rows of ``SKETCH`` counters and one for letters."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows

    @functools.cached_property
    def _memo(self) -> dict:
        return {}

    @functools.cached_property
    def _cells(self) -> tuple[memoryview, memoryview]:
        return memoryview(np.ascontiguousarray(self.rows[0])), memoryview(np.ascontiguousarray(self.rows[1]))

    def log(self, a: str, b: str) -> float:
        if (hit := self._memo.get((a, b))) is not None:
            return hit
        first, second = self._cells
        i, j = _slot(ord(a), ord(b))
        both = min(first[i], second[j])
        i, j = _slot(ord(a), 0x1FFFFF)
        alone = min(first[i], second[j])
        value = math.log((both + UNSEEN) / (alone + UNSEEN * 200))
        if len(self._memo) < 1 << 20:
            self._memo[(a, b)] = value
        return value

    def score(self, text: str) -> float:
        return sum(self.log(a, b) for a, b in itertools.pairwise(text))

    def __getstate__(self):
        at = np.nonzero(self.rows.ravel())[0].astype(np.int32)
        return {"at": at, "n": self.rows.ravel()[at]}

    def __setstate__(self, state) -> None:
        self.rows = np.zeros(2 * SKETCH, np.int64)
        self.rows[state["at"]] = state["n"]
        self.rows = self.rows.reshape(2, SKETCH)


def _quoted(text: str, start: int, end: int) -> bool:
    return 0 < start and end < len(text) and text[start - 1] in _QUOTES[0] and text[end] in _QUOTES[1]


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of non-ASCII characters; a run between quotes is reported without the typographic quotes around it."""
    for m in RUN.finditer(text):
        a, b = m.span()
        if b - a > 2 and text[a] in "“‘«„" and text[b - 1] in "”’»“" and not RUN.fullmatch(text[a + 1 : b - 1]) is None:
            a, b = a + 1, b - 1
        yield a, b


def _shape(word: str) -> str:
    if not word:
        return ""
    if any(c.isdigit() for c in word):
        return "#"
    return "X" if word[0].isupper() else word.lower().strip(".,;:!?")


def _alone(text: str, start: int, end: int) -> tuple[str, str] | None:
    """The shapes of the words around a character that stands alone between blanks."""
    before = text[max(0, start - 40) : start]
    after = text[end : end + 40]
    if (before and not before[-1].isspace()) or (after and not after[0].isspace()):
        return None
    return _shape((before.split() or [""])[-1]), _shape((after.split() or [""])[0])


def key_of(*parts: str | None) -> int:
    """A 64-bit number of a run with its source, neighbours and slot."""
    data = "\x00".join("\x01" if p is None else p for p in parts).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def runs_of(source: str, text: str, memo: dict) -> Iterator[tuple[int, int, int, tuple]]:
    """(start, stop, key, (source, before, piece, after, slot_a, slot_b)) of the runs of a text that may be garbled."""
    for a, b in _stretches(text):
        if _quoted(text, a, b):
            continue
        piece = text[a:b]
        slot = _alone(text, a, b) if piece == SIGN else None
        kind = (source, text[a - 1] if a else " ", piece, text[b] if b < len(text) else " ", *(slot or (None, None)))
        if (key := memo.get(kind)) is None:
            key = key_of(*kind) if SIGN in piece or readings(piece) else 0
            if len(memo) < 1 << 18:
                memo[kind] = key
        if key:
            yield a, b, key, kind


_SEEN = "kind int, key long, source string, before string, piece string, after string, slot_a string, slot_b string, n long"
RUNS, COUNTS, SLOTS = 0, 1, 2
FLUSH = 200_000


def seen(documents: DataFrame) -> DataFrame:
    """The first pass, as one table: distinct runs of a source with their neighbours and number (kind ``RUNS``), counters of
    the bigram sketch (``COUNTS``, ``key`` is the slot), and the word shapes around lone non-ASCII characters (``SLOTS``)."""
    names = [f.split()[0] for f in _SEEN.split(", ")]
    types = [pa.int32(), pa.int64(), *[pa.string()] * 6, pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((2, SKETCH), np.int64)
        plain = np.zeros(1 << 14, np.int64)
        found: Counter[tuple] = Counter()
        slots: set[tuple[str, str]] = set()
        memo: dict[tuple, int] = {}

        def flush() -> pa.RecordBatch:
            out = [(RUNS, key, *kind, n) for (key, kind), n in found.items()] + [(SLOTS, key_of(*s), None, None, None, None, *s, 1) for s in slots]
            found.clear(), slots.clear()
            return table(out)

        for batch in batches:
            whole = []
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                if text.isascii():
                    code = np.frombuffer(f" {text} \x00".encode("ascii"), np.uint8).astype(np.int32)
                    plain += np.bincount((code[:-1] << 7) | code[1:], minlength=1 << 14)
                    continue
                # One text a line, with a blank on either side; a batch is counted as a whole.
                whole.append(f" {text} \x00")
                for _, _, key, kind in runs_of(source, text, memo):
                    found[key, kind] += 1
                for m in re.finditer(r"(?<!\S)[^\x00-\x7f](?!\S)", text):
                    if m.group() != SIGN and (slot := _alone(text, *m.span())):
                        slots.add(slot)
            code = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(code) > 1:
                for a, b in ((code[:-1], code[1:]), (code[:-1], np.full(len(code) - 1, 0x1FFFFF, np.uint32))):
                    for row, at in zip(rows, _slots(a, b)):
                        row += np.bincount(at, minlength=SKETCH)
            if len(found) > FLUSH:
                yield flush()
        pair = np.nonzero(plain)[0]
        for a, b in ((pair >> 7, pair & 127), (pair >> 7, np.full(len(pair), 0x1FFFFF))):
            for row, at in zip(rows, _slots(a, b)):
                np.add.at(row, at, plain[pair])
        yield flush()
        at = np.nonzero(rows.ravel())[0]
        empty = pa.nulls(len(at), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), COUNTS, np.int32)), pa.array(at), *[empty] * 6, pa.array(rows.ravel()[at])], names)

    first = [F.first(c).alias(c) for c in names[2:-1]]
    return once(_rows(documents), "doc_id").select("source", "text").mapInArrow(run, _SEEN).groupBy("kind", "key").agg(*first, F.sum("n").alias("n"))


def counters(table: DataFrame) -> np.ndarray:
    """The bigram sketch of (key, n); what reaches the driver is bounded by the sketch."""
    counted = table.select("key", "n").toArrow()
    rows = np.zeros(2 * SKETCH, np.int64)
    rows[counted.column("key").to_numpy()] = counted.column("n").to_numpy()
    return rows.reshape(2, SKETCH)


def scored(runs: DataFrame, model: Bigrams) -> DataFrame:
    """(key, source, before, piece, after, n, swaps, scores): runs that some swap explains about as well as none."""
    names = ["key", "source", "before", "piece", "after", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, swaps, scores = [], [], []
            for i, (before, text, after) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("before", "piece", "after")))):
                own = model.score(before + text + after)
                best: dict[int, float] = {0: own}
                for swap, meant in readings(text):
                    score = model.score(before + meant + after)
                    if score > own - 5:
                        best[swap] = max(score, best.get(swap, -math.inf))
                if len(best) > 1:
                    keep.append(i), swaps.append(list(best)), scores.append(list(best.values()))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], pa.array(swaps, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64()))], [*names, "swaps", "scores"])

    return runs.select(*names).mapInArrow(run, "key long, source string, before string, piece string, after string, n long, swaps array<int>, scores array<double>")


def channel(source: str) -> int:
    return zlib.crc32(source.encode("utf-8", "surrogatepass")) % CHANNELS


#: Counters of the tables from characters to letters, over all sources: the driver holds at most these.
LETTERS = 1 << 20


def _letter(at: int, seen_: str, meant: str | None) -> int:
    return zlib.crc32(f"{at}\x00{seen_}\x00{meant}".encode("utf-8", "surrogatepass")) % LETTERS


class Channels:
    """What the sources do: per channel the share of every swap, and how often a character stands for a letter."""

    def __init__(self) -> None:
        self.shares: dict[int, dict[int, float]] = {}
        self.letters: dict[int, float] = {}

    def prior(self, source: str, run: str, number: int, meant: str) -> float:
        """Log weight of a reading: the share of its swap, and once letters are counted no more than the mean of its letters'
        log weights. A letter alone proves no swap: read for itself, chance likeness of rare words would feed itself."""
        at = channel(source)
        share = self.shares.get(at)
        swap = share[number] if share else (0.0 if number == 0 else math.log(START))
        if not self.letters:
            return swap
        parts = units(run, meant, number)
        weight = math.exp(swap)
        total = 0.0
        for seen_, letter in parts:
            # A letter the table does not know yet is as likely as its swap.
            both, alone = self.letters.get(_letter(at, seen_, letter), 0.0), self.letters.get(_letter(at, seen_, None), 0.0)
            total += math.log((min(both, alone) + weight) / (alone + 1))
        return min(swap, total / len(parts)) if number else swap

    def posterior(self, source: str, run: str, swaps: list[int], scores: list[float]) -> tuple[list[float], list[str]]:
        meant = dict(readings(run))
        texts = [run if k == 0 else meant[k] for k in swaps]
        logs = [s + self.prior(source, run, k, t) for k, s, t in zip(swaps, scores, texts)]
        top = max(logs)
        weights = [math.exp(x - top) for x in logs]
        return [w / sum(weights) for w in weights], texts


def learned(runs: DataFrame, rounds: int = ROUNDS) -> Channels:
    """Swaps and letters of every source, by expectation-maximisation over the scored runs and their numbers."""
    state = Channels()
    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], now: Channels = state) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], float] = {}
            for batch in batches:
                for source, run, n, swaps, scores in zip(*(batch.column(c).to_pylist() for c in ("source", "piece", "n", "swaps", "scores"))):
                    at = channel(source)
                    weights, texts = now.posterior(source, run, swaps, scores)
                    for swap, weight, text in zip(swaps, weights, texts):
                        weight *= n
                        total[at, swap] = total.get((at, swap), 0.0) + weight
                        for seen_, letter in units(run, text, swap) if weight > 1e-6 else ():
                            for slot in ((-1, _letter(at, seen_, letter)), (-1, _letter(at, seen_, None))):
                                total[slot] = total.get(slot, 0.0) + weight
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.float64())], ["channel", "slot", "w"])

        columns = ["source", "piece", "n", "swaps", "scores"]
        rows = runs.select(*columns).mapInArrow(step, "channel int, slot int, w double").groupBy("channel", "slot").agg(F.sum("w").alias("w")).toArrow()
        state = Channels()
        per: dict[int, dict[int, float]] = {}
        for at, slot, w in zip(*(rows.column(c).to_pylist() for c in ("channel", "slot", "w"))):
            if at < 0:
                state.letters[slot] = w
            else:
                per.setdefault(at, {})[slot] = w
        for at, own in per.items():
            whole = sum(own.values()) + len(LABELS) * START
            state.shares[at] = {s: math.log((own.get(s, 0.0) + START) / whole) for s in range(len(LABELS))}
    return state


def chosen(runs: DataFrame, state: Channels) -> DataFrame:
    """(key, swap, before, piece, after, meant, n) of the scored runs that are garbled; ``meant`` is their translation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick, meant = [], []
            for source, piece, swaps, scores in zip(*(batch.column(c).to_pylist() for c in ("source", "piece", "swaps", "scores"))):
                p, texts = state.posterior(source, piece, swaps, scores)
                best = p.index(max(p))
                parts = units(piece, texts[best], swaps[best])
                single = all(len(s) == 1 for s, _ in parts)
                pick.append(swaps[best])
                meant.append(piece.translate({ord(s): t for s, t in parts}) if single else "".join(t for _, t in parts))
            swap = pa.array(pick, pa.int32())
            columns = [batch.column("key"), swap, *[batch.column(c) for c in ("before", "piece", "after")], pa.array(meant, pa.string()), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, ["key", "swap", "before", "piece", "after", "meant", "n"]).filter(pa.compute.not_equal(swap, 0))

    return runs.mapInArrow(run, "key long, swap int, before string, piece string, after string, meant string, n long")


def corrections(garbled: DataFrame) -> np.ndarray:
    """What the bigram sketch changes by when garbled runs are read as meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for before, piece, after, meant, n in zip(*(batch.column(c).to_pylist() for c in ("before", "piece", "after", "meant", "n"))):
                for text, sign in ((before + piece + after, -n), (before + meant + after, n)):
                    for x, y in itertools.pairwise(text):
                        for slots in (_slot(ord(x), ord(y)), _slot(ord(x), 0x1FFFFF)):
                            for r, slot in enumerate(slots):
                                total[r * SKETCH + slot] += sign
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["key", "n"])

    rows = garbled.select("before", "piece", "after", "meant", "n").mapInArrow(run, "key long, n long")
    return counters(rows.groupBy("key").agg(F.sum("n").alias("n")))


def _rows(documents: DataFrame) -> DataFrame:
    rows = name_free(documents, "doc_id", "source", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")


def _candidates(documents: DataFrame) -> DataFrame:
    return _rows(documents).where(F.octet_length("text") > F.char_length("text"))


def garbled_kinds(documents: DataFrame) -> DataFrame:
    """(key, swap, meant): every garbled kind of run of a source; damage that lost something has swap -1 and no meaning."""
    table = cut(seen(documents))
    runs = table.where(f"kind = {RUNS}")
    lost = F.instr("piece", SIGN) > 0
    rows = counters(table.where(f"kind = {COUNTS}"))
    texts = scored(runs.where(~lost), Bigrams(rows))
    texts = cut(texts)
    # The bigrams are re-estimated once from the runs as the first rounds read them, so that common garbling does not
    # pass as language.
    rows = np.maximum(rows + corrections(chosen(texts, learned(texts))), 0)
    texts = cut(scored(runs.where(~lost), Bigrams(rows)))
    found = chosen(texts, learned(texts)).select("key", "swap", "meant")
    # A lone sign whose slot never holds a letter is only named.
    slots = table.where(f"kind = {SLOTS}").select("slot_a", "slot_b").distinct()
    signs = runs.where(lost)
    damage = signs.where("slot_a IS NULL").select("key").unionAll(signs.where("slot_a IS NOT NULL").join(slots, ["slot_a", "slot_b"], "left_semi").select("key"))
    return cut(found.unionByName(damage.select("key", F.lit(-1).alias("swap"), F.lit(None).cast("string").alias("meant"))))


#: Bits of the filter on which the second pass keeps runs; what passes is joined exactly.
FILTER = 1 << 22


def garbled_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text_id, source, start, stop, lost, swap, meant): every garbled run of every document.

    ``text_id`` tells the texts of a document with several rows apart.
    """
    kinds = garbled_kinds(documents)
    bits = np.zeros(FILTER // 8, np.uint8)
    # At most one row for each byte of the filter.
    byte = F.floor(F.pmod("key", F.lit(FILTER)) / 8).cast("int")
    for b, v in kinds.groupBy(byte.alias("b")).agg(F.bit_or(F.expr("shiftleft(1, cast(pmod(key, 8) as int))")).alias("v")).collect():
        bits[b] = v
    schema = "doc_id long, text_id long, source string, start int, stop int, key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text_id, source, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "source", "text"))):
                for a, b, key, _ in runs_of(source, text, memo):
                    at = key % FILTER
                    if bits[at >> 3] >> (at & 7) & 1:
                        out.append((doc_id, text_id, source, a, b, key))
            columns = list(zip(*out)) if out else [[] for _ in range(6)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in schema.split(", ")])

    placed = _candidates(documents).withColumn("text_id", F.xxhash64("text")).select("doc_id", "text_id", "source", "text").mapInArrow(run, schema)
    joined = placed.join(kinds, "key").distinct()
    return joined.select("doc_id", "text_id", "source", "start", "stop", (F.col("swap") < 0).alias("lost"), "swap", "meant")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents with any garbled part. Null ids, null, empty and ASCII texts are no cases; repeated rows
    count once; extra columns are ignored; an empty table gives an empty result."""
    return garbled_runs(documents).select("doc_id").distinct()


def restored_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_runs, n_lost, restored): garbled documents with every run translated that lost nothing."""
    runs = garbled_runs(documents)
    per = runs.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "meant"))).alias("runs"))
    texts = _candidates(documents).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    # Texts are shuffled only if they are garbled.
    hit = texts.join(per.select("doc_id", "text_id"), ["doc_id", "text_id"], "left_semi").dropDuplicates(["doc_id", "text_id"])
    joined = hit.join(per, ["doc_id", "text_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_text, counts, lost = [], [], []
            for text, pieces in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                out, at = [], 0
                for piece in pieces:
                    start, stop, meant = piece["start"], piece["stop"], piece["meant"]
                    out += [text[at:start], text[start:stop] if meant is None else meant]
                    at = stop
                out_text.append("".join([*out, text[at:]]))
                counts.append(len(pieces))
                lost.append(sum(p["meant"] is None for p in pieces))
            arrays = [batch.column("doc_id"), pa.array(out_text, pa.string()), pa.array(counts, pa.int32()), pa.array(lost, pa.int32()), pa.array([x == 0 for x in lost], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_runs", "n_lost", "restored"])

    return joined.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, text string, n_runs int, n_lost int, restored boolean")


def swaps_by_source(documents: DataFrame) -> DataFrame:
    """(source, swap, n_runs, n_documents): the code-page swaps found in every source; ``lost`` for replacement signs."""
    names = F.array(*[F.lit(x) for x in LABELS])
    label = F.when(F.col("swap") < 0, F.lit("lost")).otherwise(F.get(names, F.col("swap")))
    return garbled_runs(documents).groupBy("source", label.alias("swap")).agg(F.count("*").alias("n_runs"), F.countDistinct("doc_id").alias("n_documents"))
