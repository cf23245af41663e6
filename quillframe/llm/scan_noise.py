"""Problem 1: noise in text from scanned pages.

Method.  One pass counts the words of all lines, and how often each word stands in the first line of a page.  Every
word then meets the words it may be a misreading of in a join on character q-grams (of a fold under which confusable
characters are equal; the rarest grams of a word suffice), and a gradient-boosted ranking over frequencies, confusions
and lengths chooses its replacement.  A second pass over the pages in reading order classifies lines and pairs of lines:
furniture (running heads and feet, stamps, page numbers) and joins (words broken at a line end).  Both classifiers are
boosted trees that learn from what some engines' runs have cleaned: a line missing inside its block's text is furniture,
two lines whose ends are fused in it are a join.  Tokens a page does not decide go to a join with the ranked words, so
the vocabulary that travels with the pass is bounded and nothing is lost beyond it.

Pages of one document are processed in sections of ``PAGES`` pages; the neighbouring page of each section travels along.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.boost import Boosted
from quillframe.llm.canon import transducer
from quillframe.llm.common import SKETCH_BUCKETS, cut, grouped, histogram, name_free, salted_join
from quillframe.llm.noise import DIGIT_LETTERS, confusions, fold

PAGES = 8
#: Words that travel with the second pass; all others are looked up by a join.
CARRIED = 100_000
#: Rows of the samples on which the two line classifiers and the ranking are fitted.
SAMPLE = 20_000
#: How many times as often as a misreading its source occurs at least.
RATIO = 6.0
GRAM = 3
#: Distance, in folded characters, within which candidates are retrieved.
DISTANCE = 1
FLUSH = 400_000
#: Bits of the filter over the words that do not travel, so that a broken one among them is looked up.
FILTER = 1 << 20

_MARKER = re.compile(r"^\W{0,2}([bB8])([0OoQ]?[\dOolI|SsZ]{1,2})(?:[\])>][:.]?|[:.)])(?:\s+|$)")
_OPENERS = frozenset("bB8[<({ ")
_BREAK = "-¬~=‐‑­"
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_EDGES = ".,;:?()[]{}<>“”‘’\"'«»¿¡…%€°/*·–—"
_PAGE_NUMBER = re.compile(
    r"(?:(?:page|seite|sheet|pg|p|s|página|pág|folio|blatt|feuille|쪽)\.?\s*)?[-–\[(]?\s*(\d{1,4}|[ivxlc]{1,6})\s*[-–\])]?(?:\s*(?:of|/|von|de|sur|out of)\s*\d{1,4})?", re.I
)
_CONJUNCTION = {"und", "oder", "and", "or", "y", "o", "et", "ou", "bis", "to"}
_NUMBER_LIKE = re.compile(rf"[\d{re.escape(DIGIT_LETTERS)}](?:[.,]?[\d{re.escape(DIGIT_LETTERS)}])*")
_SIGN = re.compile(r"[A-Za-zÀ-ɏ][@!|$\d]|[@!|$\d][A-Za-zÀ-ɏ]")
_ALONE = set("ZSBOlIbgq|")


def plain(text: str) -> str:
    return text if text.isascii() else transducer().rewrite(text)


def marker(text: str, block_id: str | None) -> int:
    """Where the body starts if the line opens a block, else 0."""
    if text[:1] not in _OPENERS:
        return 0
    m = _MARKER.match(text)
    if not m:
        return 0
    if block_id is not None and m.group(1) == "8" and block_id.lower()[:1] != "b":
        return 0
    digits = m.group(2).translate(str.maketrans("OoQlI|SsZ", "000111552"))
    if block_id is not None and block_id[1:].isdigit() and digits.isdigit() and int(block_id[1:]) != int(digits):
        return 0
    return m.end()


def core(token: str) -> str:
    return token.strip(_EDGES).rstrip("!") if not token.isalpha() else token


def number_misread(word: str) -> bool:
    """A number with letters in place of digits, or a letter standing alone for a digit."""
    if word in _ALONE:
        return word not in "|I"
    if not _NUMBER_LIKE.fullmatch(word) or not any(c.isdigit() for c in word):
        return False
    return not word.replace(".", "").replace(",", "").isdigit() and not re.fullmatch(r"[bB]\d\d", word)


def pieces(word: str) -> list[str]:
    """The parts of a compound or an elided word, lower-cased."""
    return [p for p in re.split(r"[-'’/]", word.lower()) if p]


# --- first pass -------------------------------------------------------------------------------------------------


def word_counts(lines: DataFrame) -> DataFrame:
    """(word, n, first): lower-cased words of all lines, and how many stand in the first line of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[str] = Counter()
        first: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(every | first)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([every[k] for k in keys], pa.int64()), pa.array([first[k] for k in keys], pa.int64())], ["word", "n", "first"])
            every.clear(), first.clear()
            return out

        for batch in batches:
            for text, order, block_id in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = plain(text)
                at = marker(text, block_id)
                tokens = text[at:].split()
                if tokens and (len(tokens[-1]) > 1 and tokens[-1][-1] in _BREAK):
                    tokens.pop()
                out = []
                for token in tokens:
                    if token.isalpha():
                        out.append(token.lower())
                    else:
                        word = core(token)
                        if word and not word[0].isdigit() or _SIGN.search(word):
                            out += pieces(word)
                if order == 0 and not at:
                    first.update(out)
                else:
                    every.update(out)
            if len(every) > FLUSH:
                yield flush()
        yield flush()

    rows = lines.select("text", "source_order", "block_id").mapInArrow(run, "word string, n long, first long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))


def _grams(folded: str) -> list[str]:
    padded = f"^{folded}$"
    return [padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))]


def candidate_pairs(words: DataFrame) -> DataFrame:
    """(seen, seen_n, meant, meant_n): words and the far more frequent words whose folds are within ``DISTANCE``.

    Two folds within the distance share one of their ``GRAM * DISTANCE + 1`` rarest grams, so only those are joined.
    Folds of up to ``GRAM`` characters may share none; they are keyed by themselves and by each one without a character
    as well, and two of them within the distance share such a key.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [fold(word) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("word", "n", "all")], pa.array(f, pa.string())], ["word", "n", "all", "folded"])

    # A word seen only in the first lines of pages may be a misreading too, but only body lines show what is meant.
    head = F.coalesce("first", F.lit(0)) if "first" in words.columns else F.lit(0)
    counted = words.select("word", F.col("n"), (F.col("n") + head).alias("all"))
    folded = cut(counted.where("all > 0").mapInArrow(spread, "word string, n long, all long, folded string"))

    def all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([g for f in batch.column(0).to_pylist() for g in set(_grams(f))], pa.string())], ["gram"])

    counts = histogram(folded.select("folded").mapInArrow(all_grams, "gram string").select(F.xxhash64("gram").alias("gram")), "gram")
    ranks = folded.select("word", "n", "all", "folded", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("folded") + 2 - GRAM)), lambda i: F.substring(F.concat(F.lit("^"), F.col("folded"), F.lit("$")), i + 1, F.lit(GRAM))).alias("grams"))
    hashed = ranks.withColumn("grams", F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g))))
    size = F.length("folded")
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size)), lambda i: F.concat(F.substring(F.col("folded"), F.lit(1), i - 1), F.substring(F.col("folded"), i + 1, size)))
    short = F.transform(F.array_distinct(F.concat(F.array("folded"), less)), lambda v: F.xxhash64(F.concat(F.lit("\x01"), v)))
    hashed = hashed.withColumn("short", F.when(size <= GRAM, short))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, gram = [], []
            for i, (grams, short) in enumerate(zip(batch.column("grams").to_pylist(), batch.column("short").to_pylist())):
                for g in sorted(grams, key=lambda g: (counts[g % SKETCH_BUCKETS], g))[: GRAM * DISTANCE + 1] + (short or []):
                    take.append(i), gram.append(g)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), *[batch.column(c).take(at) for c in ("word", "n", "all", "folded")]], ["gram", "word", "n", "all", "folded"])

    index = cut(hashed.mapInArrow(rarest, "gram long, word string, n long, all long, folded string"))
    seen = index.select("gram", F.col("word").alias("seen"), F.col("all").alias("seen_n"), F.col("folded").alias("seen_f"))
    meant = index.where(F.col("n") >= RATIO).select("gram", F.col("word").alias("meant"), F.col("n").alias("meant_n"), F.col("folded").alias("meant_f"))
    near = (F.col("meant_n") >= RATIO * F.col("seen_n")) & (F.abs(F.length("seen_f") - F.length("meant_f")) <= DISTANCE)
    # A gram of very many words is dealt into cells, see salted_join.
    pairs = salted_join(meant, seen, "gram").where(near).where((F.col("seen_f") == F.col("meant_f")) | (F.levenshtein("seen_f", "meant_f", DISTANCE) >= 0))
    return pairs.select("seen", "seen_n", "meant", "meant_n").distinct()


def _pair_features(seen: str, seen_n: int, meant: str, meant_n: int) -> list[float]:
    ops = confusions(seen, meant)
    return [
        math.log(meant_n / max(seen_n, 1)), math.log(seen_n + 1), math.log(meant_n + 1), 9.0 if ops is None else float(ops),
        float(len(seen)), float(len(meant)), float(sum(not c.isalpha() for c in seen)), float(seen[:1] != meant[:1]), float(fold(seen) == fold(meant)),
    ]


def fit_ranking(words: list[tuple[str, int]]) -> Boosted:
    """The ranking, fitted on frequent words: misreadings made by the known confusions against other near words.

    ``words`` is a sample of at most ``SAMPLE`` frequent words with their counts.
    """
    count = dict(words)
    x, y = [], []
    by_fold: dict[str, list[str]] = defaultdict(list)
    for w in count:
        by_fold[fold(w)].append(w)
    rng = np.random.default_rng(7)
    from quillframe.llm.noise import CONFUSIONS

    for word, n in words:
        options = [(p, r, i) for p, r in CONFUSIONS for i in range(len(word)) if word.startswith(p, i)]
        for k in rng.permutation(len(options))[:3]:
            printed, read, at = options[k]
            seen = word[:at] + read + word[at + len(printed) :]
            seen_n = count.get(seen, max(1, int(n * 0.004)))
            # A misreading that is a frequent word itself cannot be told from it.
            x.append(_pair_features(seen, seen_n, word, n))
            y.append(float(n >= RATIO * seen_n))
        for other in by_fold[fold(word)]:
            if other != word:
                x.append(_pair_features(word, n, other, count[other]))
                y.append(float((confusions(word, other) is not None) and count[other] >= 20 * n))
        # Another word of the corpus at random, and a change no confusion explains.
        at = int(rng.integers(len(word)))
        seen = word[:at] + "aeiounrst"[int(rng.integers(9))] + word[at + 1 :]
        if seen != word and confusions(seen, word) is None:
            x.append(_pair_features(seen, max(1, int(n * 0.004)), word, n))
            y.append(0.0)
    return Boosted(trees=30).fit(np.array(x or [[0.0] * 9]), np.array(y or [0.0]))


def ranked(pairs: DataFrame, model: Boosted) -> DataFrame:
    """(seen, meant, score): the best replacement of every word that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            if not rows:
                continue
            x = np.array([_pair_features(*r) for r in rows])
            score = np.where(x[:, 3] > 4, 0.0, model.predict(x))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), batch.column(3)], ["seen", "meant", "score", "meant_n"])
            yield out.filter(pa.array(score >= 0.5))

    scored = pairs.mapInArrow(run, "seen string, meant string, score double, meant_n long")
    best = scored.groupBy("seen").agg(F.max(F.struct("score", "meant_n", "meant")).alias("b"))
    return best.select("seen", F.col("b.meant").alias("meant"), F.col("b.score").alias("score"))


# --- second pass ------------------------------------------------------------------------------------------------


class Lexicon:
    """The part of the vocabulary that travels: counts of sound words, and how strongly a word marks furniture."""

    def __init__(self, counts: dict[str, int], edge: dict[str, float], least: int, others: np.ndarray | None = None) -> None:
        self.counts, self.edge, self.least = counts, edge, least
        self.others = others
        self.order = sorted(counts)
        marks = [w for w, v in edge.items() if v > 1.5]
        self.marks = frozenset(x for w in marks for x in (w, w.upper(), w.capitalize(), w.capitalize().swapcase()))

    def begins(self, part: str) -> bool:
        """Whether a longer word begins like this."""
        at = bisect.bisect_right(self.order, part)
        return at < len(self.order) and self.order[at].startswith(part)

    def n(self, word: str) -> int:
        return self.counts.get(word, 0)

    def maybe(self, word: str) -> bool:
        """Whether the word may be one of those that do not travel; never false for one that is."""
        if self.others is None:
            return False
        at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % FILTER
        return bool(self.others[at >> 3] >> (at & 7) & 1)


def rest_filter(words: DataFrame) -> np.ndarray | None:
    """A filter of ``FILTER`` bits over (word); None if there is none."""
    at = F.pmod(F.crc32("word"), F.lit(FILTER))
    rows = words.groupBy(F.floor(at / 8).cast("int").alias("b")).agg(F.expr(f"bit_or(shiftleft(1, cast(pmod(crc32(word), {FILTER}) % 8 as int)))").alias("v")).collect()
    if not rows:
        return None
    bits = np.zeros(FILTER // 8, np.uint8)
    for b, v in rows:
        bits[b] = v
    return bits


def sections(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines and blocks of one section of a document together, in reading order; repeated rows once."""
    if "confidence" not in lines.columns:
        lines = lines.withColumn("confidence", F.lit(None).cast("double"))
    a = name_free(lines, "instance_id", "engine", "page_number", "source_order", "block_id", "text", "confidence").where("text IS NOT NULL")
    page = F.coalesce("page_number", F.lit(0))
    home = F.floor((F.greatest(page, F.lit(1)) - 1) / PAGES).cast("int")
    rest = F.pmod(F.greatest(page, F.lit(1)) - 1, F.lit(PAGES))
    places = F.filter(
        F.array(F.struct(home.alias("section"), F.lit(True).alias("own")), F.struct(F.when(rest == 0, home - 1).alias("section"), F.lit(False).alias("own")), F.struct(F.when(rest == PAGES - 1, home + 1).alias("section"), F.lit(False).alias("own"))),
        lambda p: p["section"].isNotNull() & (p["section"] >= 0),
    )
    a = a.select("instance_id", "engine", F.inline(places), F.lit(0).alias("kind"), page.alias("page"), F.coalesce("source_order", F.lit(0)).alias("ord"), "block_id", "text", F.col("confidence").cast("float").alias("confidence"))
    b = name_free(blocks, "instance_id", "engine", "block_id", "text", "page_numbers").where("text IS NOT NULL")
    start = F.floor((F.greatest(F.coalesce(F.array_min("page_numbers"), F.lit(1)), F.lit(1)) - 1) / PAGES).cast("int")
    b = b.select("instance_id", "engine", start.alias("section"), F.lit(True).alias("own"), F.lit(1).alias("kind"), F.lit(0).alias("page"), F.lit(0).alias("ord"), "block_id", "text", F.lit(None).cast("float").alias("confidence"))
    keys = ["instance_id", "engine", "section"]
    return a.unionAll(b).repartition(*keys).sortWithinPartitions(*keys, "kind", "page", "ord", "block_id")


class _Line:
    __slots__ = ("page", "ord", "block", "text", "body", "at", "own", "first", "last", "furniture", "tokens", "confidence")


def _sheets(part: pa.Table) -> Iterator[tuple[str, str, list[_Line], list[tuple]]]:
    """(instance, engine, lines, blocks) of every section of a table of whole sections."""
    cols = {c: part.column(c).to_pylist() for c in part.column_names}
    n = part.num_rows
    i = 0
    inst, eng, sec = cols["instance_id"], cols["engine"], cols["section"]
    while i < n:
        j = i
        key = inst[i], eng[i], sec[i]
        lines: list[_Line] = []
        blocks: list[tuple] = []
        seen = set()
        while j < n and inst[j] == key[0] and eng[j] == key[1] and sec[j] == key[2]:
            if cols["kind"][j] == 0:
                at = cols["page"][j], cols["ord"][j], cols["text"][j]
                if at not in seen:
                    seen.add(at)
                    line = _Line()
                    line.page, line.ord, line.block, line.own = at[0], at[1], cols["block_id"][j], cols["own"][j]
                    line.text = plain(at[2])
                    line.confidence = cols["confidence"][j]
                    line.at = marker(line.text, line.block)
                    line.tokens = line.text[line.at :].split()
                    line.body = line.text[line.at :].strip()
                    line.furniture = False
                    lines.append(line)
            elif (at := (cols["block_id"][j], cols["text"][j])) not in seen:
                seen.add(at)
                blocks.append((at[0], plain(at[1]), at[1]))
            j += 1
        open_block = None
        for k, line in enumerate(lines):
            line.first = k == 0 or lines[k - 1].page != line.page
            line.last = k + 1 == len(lines) or lines[k + 1].page != line.page
            if line.at:
                digits = _MARKER.match(line.text).group(2).translate(str.maketrans("OoQlI|SsZ", "000111552"))
                open_block = line.block or f"b{int(digits):02d}"
            elif line.block is not None:
                open_block = line.block
            line.block = open_block
        yield key[0], key[1], lines, blocks
        i = j


def _key(text: str) -> str:
    return re.sub(r"[\d\W]+", "", text).lower()


def _suspects(lines: list[_Line], lex: Lexicon) -> Iterator[tuple[_Line, list[float]]]:
    """Lines that may be furniture, with features."""
    repeated = Counter(_key(x.text) for x in lines if x.first)
    for k, line in enumerate(lines):
        if line.at or not line.body:
            continue
        if not (line.first or line.last) and lex.marks.isdisjoint(line.tokens):
            continue
        words = [w.lower() for w in _WORD.findall(line.body)]
        m = _PAGE_NUMBER.fullmatch(line.body)
        scores = [lex.edge.get(w, 0.0) for w in words]
        before = next((lines[i].body for i in range(k - 1, -1, -1) if not lines[i].first or lines[i].at), "") if k else ""
        tail = re.search(r"\s(\d{1,4})$", line.body)
        letters = [c for c in line.body if c.isalpha()]
        yield line, [
            float(line.first), float(line.last), float(m is not None), float(bool(m) and _numbers(m.group(1), line.page)),
            sum(scores) / len(scores) if scores else 0.0, max(scores, default=0.0), float(sum(s > 1.5 for s in scores)), float(len(words)),
            float(repeated[_key(line.text)] > 1 and line.first), float(bool(tail) and tail.group(1) == str(line.page)),
            sum(c.isupper() for c in letters) / len(letters) if letters else 0.0, float(line.body[:1].islower()), float(line.body[-1] in ".?!,;"),
            float(before[-1:] in ".?!”" if before else 1.0), float(any(c in line.body for c in "·|–")), float(len(line.body)),
            -1.0 if line.confidence is None else line.confidence,
        ]


_ROMAN = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")


def _numbers(text: str, page: int) -> bool:
    """Whether a page number, arabic or roman, is that of the page."""
    return text == str(page) or (0 < page < len(_ROMAN) and text.lower() == _ROMAN[page])


def _sure_furniture(f: list[float]) -> bool:
    """What the classifier is started from where too few cleaned blocks exist."""
    if f[2]:
        return bool((f[0] or f[1]) and (f[3] or f[15] > 2))
    return not f[12] and bool((f[0] and (f[4] > 1.0 or f[8])) or (f[6] >= 2 and f[4] > 1.5))


def _parts(a: str, b: str) -> tuple[str, str, str] | None:
    """(first part, break mark, second part) of two tokens that may be one broken word."""
    mark = a[-1:] if a[-1:] in _BREAK and len(a) > 1 and a[-2:-1].isalpha() else ""
    head = a[:-1] if mark else a
    m = re.search(r"[^\W\d_]+(?:['’-][^\W\d_]+)*$", head)
    n = re.match(r"[^\W\d_]+", b)
    if not m or not n or (not mark and (len(m.group()) < 2 or core(b) != n.group())):
        return None
    return m.group().lower(), mark, n.group()


def _join_features(a: str, mark: str, b: str, lex: Lexicon) -> list[float] | None:
    """Features of a possible join; None if nothing speaks for one."""
    lower = b.lower()
    left = re.split(r"['’-]", a)[-1]
    whole = lex.n(left + lower)
    if not mark and (whole < lex.least or not b[:1].islower()):
        return None
    n_a, n_b = lex.n(left), lex.n(lower)
    ratio = math.log((whole + 0.5) / (min(n_a, n_b) + 0.5))
    return [float(bool(mark)), math.log(n_a + 1), math.log(n_b + 1), math.log(whole + 1), ratio, float(len(left)), float(len(lower)), float(b[:1].islower()), float(lower in _CONJUNCTION)]


def _sure_join(f: list[float]) -> bool:
    return (not f[8] or f[3] > 1.7) and (bool(f[0]) or f[4] > 1.0)


def _joined(rows: list[list[float]], joins: Boosted | None) -> np.ndarray:
    """Which possible joins are joins: a mark or a whole far more frequent than its rarer part is sure, the rest learned."""
    sure = np.array([_sure_join(f) for f in rows])
    if joins is None:
        return sure
    x = np.array(rows)
    return sure & ((x[:, 0] > 0) | (x[:, 4] > 2.0)) | (joins.predict(x) >= 0.5) & (x[:, 4] > 0)


def _bodies(lines: list[_Line]) -> Iterator[tuple[_Line, _Line]]:
    """Pairs of successive body lines of one block."""
    before = None
    for line in lines:
        if line.furniture or not line.body:
            continue
        if before is not None and not line.at and line.block == before.block:
            yield before, line
        before = line


def fit_lines(paged: DataFrame, lex: Lexicon, documents: int) -> tuple[Boosted | None, Boosted | None]:
    """The furniture and join classifiers, from blocks that some run has cleaned; at most ``SAMPLE`` rows are used."""
    schema = "kind int, y double, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, float, list[float]]] = []
            for _, _, lines, blocks in _sheets(part):
                text = {b: p for b, p, _ in blocks}
                rows = list(_suspects(lines, lex))
                held: dict[str | None, list] = defaultdict(list)
                order = {id(x): k for k, x in enumerate(lines)}
                for line, f in rows:
                    line.furniture = _sure_furniture(f)
                for line, f in rows:
                    k = order[id(line)]
                    inside = 0 < k < len(lines) - 1 and any(x.block == line.block and not x.furniture for x in lines[max(0, k - 3) : k]) and any(x.block == line.block and not x.at and not x.furniture for x in lines[k + 1 : k + 4])
                    if line.block in text and inside:
                        near = next((x.body for x in reversed(lines[max(0, k - 3) : k]) if x.body and not x.furniture), "").split()
                        held[line.block].append((line, f, f"{near[-1] if near else ''} {line.body}" in text[line.block] or (len(line.body) > 8 and line.body in text[line.block])))
                for block, inner in held.items():
                    after = [x.body for x in lines if x.block == block and not x.furniture][-1:]
                    whole = not after or after[0][-8:] in text[block]
                    if whole and any(not kept for _, _, kept in inner):  # this block was cleaned
                        out += [(0, float(not kept), f) for _, f, kept in inner]
                for a, b in _bodies(lines):
                    if a.block not in text or not a.body or not b.body:
                        continue
                    left, right = a.body.split()[-1], b.body.split()[0]
                    if not (p := _parts(left, right)) or (f := _join_features(*p, lex)) is None:
                        continue
                    block = text[a.block]
                    stem = left[:-1] if p[1] else left
                    fused = stem + right in block or (bool(p[1]) and f"{stem}-{right}" in block)
                    apart = f"{left} {right}" in block
                    if fused != apart:
                        out.append((1 if fused else 2, float(fused), f))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["kind", "y", "x"])

        yield from grouped(batches, ["instance_id", "engine", "section"], work)

    share = min(1.0, SAMPLE / 4 / max(documents, 1))
    some = paged.where(F.pmod(F.xxhash64("instance_id", "engine"), F.lit(1_000_000)) < int(share * 1_000_000))
    # In hash order, so that every run fits on the same rows.
    rows = some.mapInArrow(run, schema).orderBy(F.xxhash64("kind", "y", F.col("x").cast("string"))).limit(SAMPLE).toArrow()
    kind = rows.column("kind").to_numpy()
    y = rows.column("y").to_numpy()
    x = rows.column("x").to_pylist()

    def fit(mask: np.ndarray, width: int, label: np.ndarray) -> Boosted | None:
        at = np.nonzero(mask)[0]
        if (label[at] == 1).sum() < 100 or (label[at] == 0).sum() < 20:
            return None
        return Boosted(trees=25).fit(np.array([x[i] for i in at]).reshape(-1, width), label[at])

    return fit(kind == 0, 17, y), None if not len(kind) else _fit_join(kind, x)


def _fit_join(kind: np.ndarray, x: list[list[float]]) -> Boosted | None:
    """Joins that a run fused are true; pairs it left apart are unlabelled, and false only where no sign speaks for one."""
    rows, label = [], []
    for k, f in zip(kind, x):
        if k == 1:
            rows.append(f), label.append(1.0)
        elif k == 2:
            rows.append(f), label.append(float(_sure_join(f)))
    if sum(label) < 100 or len(label) - sum(label) < 20:
        return None
    return Boosted(trees=25).fit(np.array(rows), np.array(label))


def view_of(token: str, lex: Lexicon) -> tuple | None:
    """What a token shows by itself: None if it is sound, else (kind, word, text) findings; () marks a broken end."""
    if token.isalpha():
        word = token.lower()
        if len(token) == 1:
            return (("misread", None, token),) if token in _ALONE and token not in "|I" else None
        return None if word in lex.counts else (("ask", word, token),)
    word = core(token)
    end: tuple | None = () if len(token) > 1 and token[-1] in _BREAK else None
    if not word or word.isdigit():
        return end
    if number_misread(word):
        return (("misread", None, word),)
    if word.isalpha() and word.lower() in lex.counts:
        return (("misread", None, word),) if word in _ALONE and word not in "|I" else end
    found = []
    for p in pieces(word):
        if p in lex.counts or p.isdigit() or len(p) < 2:
            continue
        if p.isalpha():
            found.append(("ask", p, word))
        elif _SIGN.search(p):
            sure = sum(c.isalpha() for c in p) >= 2 and not number_misread(p) and not re.fullmatch(r"[\d.,]+[^\W\d_]+\d?", p)
            found.append(("misread" if sure else "ask", p, word))
    return tuple(found) or end


_OUT = "table_name string, instance_id string, engine string, item string, kind string, word string, part string, rarer long"


def marked(paged: DataFrame, lex: Lexicon, furniture: Boosted | None, joins: Boosted | None) -> DataFrame:
    """Rows (table_name, instance_id, engine, item, kind, word, part, rarer).

    ``kind`` is a verdict (hyphen, misread, furniture), or ``ask`` for a ``word`` the lexicon does not hold, or
    ``join?`` for a broken word whose whole (``word``) it does not hold, with the count of its ``rarer`` part. ``part`` is
    the text a repair has to replace.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple | None] = {}

        def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
            sheets = list(_sheets(part))
            asked, features = [], []
            for _, _, lines, _ in sheets:
                for line, f in _suspects(lines, lex):
                    asked.append((line, f)), features.append(f)
            if features:
                learned = furniture.predict(np.array(features)) if furniture is not None else None
                for k, (line, f) in enumerate(asked):
                    sure = _sure_furniture(f)
                    line.furniture = sure if learned is None else bool((f[2] and sure) or learned[k] >= 0.5 and (sure or (f[0] and not f[12] and (f[4] > 0.3 or f[8] or f[14]))))
            rows: list[tuple] = []
            pending: list[tuple] = []
            wanted: list[list[float]] = []

            def judge(tokens: list[str], skip: set[int], key: tuple, views: list) -> None:
                told = set()
                for k, view in enumerate(views):
                    if view is None or view == () or k in skip:
                        continue
                    for kind, word, text in view:
                        # The last token of a text may be what a cut has left of a word.
                        if k == len(views) - 1 and (len(text) == 1 or (kind == "ask" and text.isalpha() and lex.begins(word))):
                            continue
                        if (kind, word, text) not in told:
                            told.add((kind, word, text))
                            rows.append((*key, kind, word, text, None))

            def views_of(tokens: list[str]) -> list:
                out = []
                for token in tokens:
                    v = memo.get(token, 0)
                    if v == 0:
                        v = view_of(token, lex)
                        if len(memo) < 1 << 18:
                            memo[token] = v
                    out.append(v)
                return out

            for instance, engine, lines, blocks in sheets:
                for a, b in _bodies(lines):
                    ta, tb = a.tokens, b.tokens
                    if not (p := _parts(ta[-1], tb[0])):
                        continue
                    key = ("ocr_lines", instance, engine, f"{a.page}:{a.ord}")
                    f = _join_features(*p, lex)
                    if f is not None:
                        pending.append((a, b, key, f"{ta[-1]} {tb[0]}"))
                        wanted.append(f)
                    elif not p[1] and p[2][:1].islower() and (not lex.n(p[0]) or not lex.n(p[2]) or lex.maybe(p[0] + p[2])) and a.own:
                        rows.append((*key, "join?", p[0] + p[2], f"{ta[-1]} {tb[0]}", min(lex.n(p[0]), lex.n(p[2]))))
            verdict = np.zeros(0)
            if wanted:
                verdict = _joined(wanted, joins)
            cut_after: set[int] = set()
            cut_before: set[int] = set()
            for (a, b, key, text), yes in zip(pending, verdict):
                if yes:
                    cut_after.add(id(a)), cut_before.add(id(b))
                    if a.own:
                        rows.append((*key, "hyphen", None, text, None))

            block_pending: list[tuple] = []
            block_wanted: list[list[float]] = []
            for instance, engine, lines, blocks in sheets:
                inner: dict[str | None, list[tuple[str, str, str]]] = defaultdict(list)
                for k, line in enumerate(lines):
                    key = ("ocr_lines", instance, engine, f"{line.page}:{line.ord}")
                    if line.furniture:
                        before = next((lines[i].body for i in range(k - 1, max(-1, k - 4), -1) if lines[i].body), "")
                        after = next((lines[i].body for i in range(k + 1, min(len(lines), k + 4)) if lines[i].body), "")
                        inner[line.block].append((line.body, before, after))
                        if line.own:
                            rows.append((*key, "furniture", None, line.body, None))
                    elif line.own and line.body:
                        views = views_of(line.tokens)
                        if any(views):
                            skip = {0} if id(line) in cut_before else set()
                            if id(line) in cut_after or line.body[-1] in _BREAK:
                                skip.add(len(views) - 1)
                            judge(line.tokens, skip, key, views)
                for block_id, text, stored in blocks:
                    key = ("ocr_blocks", instance, engine, block_id)
                    hit = False
                    for body, before, after in inner.get(block_id, ()):
                        short = len(body) < 8
                        near = ((before.split() or [""])[-1], (after.split() or [""])[0])
                        for whole in ([f"{near[0]} {body} {near[1]}"] if short and all(near) else [body]):
                            whole = " ".join(whole.split()) if short else whole
                            at = text.find(whole)
                            if at < 0 and not short:
                                at = " ".join(text.split()).find(" ".join(whole.split()))
                                if at >= 0:
                                    text = " ".join(text.split())
                                    whole = " ".join(whole.split())
                            if at >= 0:
                                hit = True
                                rows.append((*key, "furniture", None, body, None))
                                start = at + (len(near[0]) + 1 if short and all(near) else 0)
                                text = text[:start] + text[start + len(body) :].lstrip()
                    tokens = text.split()
                    views = views_of(tokens)
                    at = [k for k, v in enumerate(views) if v is not None]
                    if not at:
                        continue
                    gone: set[int] = set()
                    for k in sorted({x for k in at for x in (k - 1, k) if 0 <= x < len(tokens) - 1}):
                        a, b = tokens[k], tokens[k + 1]
                        if a[-1] not in _BREAK and (not a.isalpha() or not b[0].islower()):
                            continue
                        if not (p := _parts(a, b)):
                            continue
                        f = _join_features(*p, lex)
                        if f is not None:
                            block_pending.append((key, f"{a} {b}"))
                            block_wanted.append(f)
                            if _sure_join(f):
                                gone |= {k, k + 1}
                        elif not p[1] and (not lex.n(p[0]) or not lex.n(p[2]) or lex.maybe(p[0] + p[2])):
                            rows.append((*key, "join?", p[0] + p[2], f"{a} {b}", min(lex.n(p[0]), lex.n(p[2]))))
                    judge(tokens, gone, key, views)
            if block_wanted:
                learned = _joined(block_wanted, joins)
                rows += [(*key, "hyphen", None, text, None) for (key, text), yes in zip(block_pending, learned) if yes]
            columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:7]] + [pa.array(columns[7], pa.int64())], [x.split()[0] for x in _OUT.split(", ")])

        yield from grouped(batches, ["instance_id", "engine", "section"], work)

    return paged.mapInArrow(run, _OUT)


class Repair:
    """All verdicts of one input: ``verdicts`` (…, kind, part, meant) and the ranked ``words`` (seen, meant)."""

    def __init__(self, lines: DataFrame, blocks: DataFrame) -> None:
        counted = cut(word_counts(name_free(lines, "text", "source_order", "block_id").where("text IS NOT NULL")))
        frequent = counted.where("n >= 20").orderBy(F.desc("n"), "word").limit(SAMPLE).select("word", "n").toArrow()
        ranking = fit_ranking(list(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist())))
        self.words = cut(ranked(candidate_pairs(counted), ranking))
        sound = counted.where("n + first >= 2").join(self.words.select(F.col("seen").alias("word")), "word", "left_anti")
        carried = sound.orderBy(F.desc(F.col("n") + F.col("first")), "word").limit(CARRIED).toArrow()
        words, n, first = (carried.column(i).to_pylist() for i in range(3))
        least = 5
        others = None
        if len(words) == CARRIED:
            # The rarest that travels, in the order of the sort; what comes after it is only in the filter.
            weight, last = n[-1] + first[-1], words[-1]
            beyond = (F.col("n") + F.col("first") < weight) | ((F.col("n") + F.col("first") == weight) & (F.col("word") > last))
            others = rest_filter(sound.where(beyond & (F.col("n") >= least)).select("word"))
        total = counted.agg(F.sum("n"), F.sum("first")).first()
        body, head = (total[0] or 0) + 1, (total[1] or 0) + 1
        edge = {w: math.log((f + 0.5) / head) - math.log((c + 0.5) / body) for w, c, f in zip(words, n, first)}
        lex = Lexicon({w: c for w, c in zip(words, n) if c >= 2}, edge, least, others)
        self.paged = sections(lines, blocks)
        documents = name_free(blocks, "instance_id", "engine").agg(F.approx_count_distinct("instance_id")).first()[0]
        furniture, joins = fit_lines(self.paged, lex, documents)
        found = cut(marked(self.paged, lex, furniture, joins))
        keys = ["table_name", "instance_id", "engine", "item"]
        known = found.where("kind NOT IN ('ask', 'join?')").select(*keys, "kind", "part", "word")
        asked = found.where("kind = 'ask'").join(self.words, found["word"] == self.words["seen"]).select(*keys, F.lit("misread").alias("kind"), "part", "word")
        whole = counted.where(F.col("n") >= least).select("word", "n").join(self.words.select(F.col("seen").alias("word")), "word", "left_anti")
        joined = found.where("kind = 'join?'").join(whole, "word").where(F.log((F.col("n") + 0.5) / (F.col("rarer") + 0.5)) > 1.0).select(*keys, F.lit("hyphen").alias("kind"), "part", "word")
        self.verdicts = known.unionAll(asked).unionAll(joined)


def noisy_items(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(table_name, instance_id, engine, item, kind) of lines and blocks with scan noise.

    Null texts are no cases; empty texts have no noise; repeated rows count once; a furniture line has no other kind;
    rows without page or order count as page 0, order 0; extra columns are ignored; empty tables give an empty result.
    """
    return Repair(lines, blocks).verdicts.select("table_name", "instance_id", "engine", "item", "kind").distinct()


def repaired_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(instance_id, engine, block_id, text, n_repairs): every block as continuous readable text.

    Furniture is removed, broken words are joined and misread words replaced by the best ranked word, where one exists.
    """
    repair = Repair(lines, blocks)
    own = repair.verdicts.where("table_name = 'ocr_blocks'").join(repair.words.select(F.col("seen").alias("word"), "meant"), "word", "left")
    todo = own.groupBy("instance_id", "engine", F.col("item").alias("block_id")).agg(F.collect_set(F.struct("kind", "part", F.col("word"), "meant")).alias("todo"))
    texts = name_free(blocks, "instance_id", "engine", "block_id", "text").where("text IS NOT NULL").distinct()
    keys = [texts[c].eqNullSafe(todo[c]) for c in ("instance_id", "engine", "block_id")]
    joined = texts.join(todo, keys, "left").select(texts["instance_id"], texts["engine"], texts["block_id"], texts["text"], "todo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for text, todo in zip(batch.column("text").to_pylist(), batch.column("todo").to_pylist()):
                text, n = plain(text), 0
                for kind in ("furniture", "hyphen", "misread"):
                    for fix in sorted((t for t in todo or [] if t["kind"] == kind), key=lambda t: -len(t["part"] or "")):
                        new = _repaired(text, kind, fix)
                        n += new != text
                        text = new
                out.append(" ".join(text.split()))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("instance_id", "engine", "block_id")], pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["instance_id", "engine", "block_id", "text", "n_repairs"])

    return joined.mapInArrow(run, "instance_id string, engine string, block_id string, text string, n_repairs int")


def _repaired(text: str, kind: str, fix: dict) -> str:
    part = fix["part"] or ""
    if kind == "furniture":
        return re.sub(rf"(?<!\S){re.escape(part)}(?!\S)\s*", "", text, count=1)
    if kind == "hyphen":
        left, _, right = part.partition(" ")
        bare = left[:-1] if left[-1:] in _BREAK else left
        return text.replace(part, bare + right)
    if fix["meant"]:
        word = fix["word"]

        def put(m: re.Match[str]) -> str:
            meant = fix["meant"]
            return meant.capitalize() if m.group()[:1].isupper() else meant

        return re.sub(rf"(?<![^\W_]){re.escape(word)}(?![^\W_])", put, text, flags=re.I)
    digits = part.translate(str.maketrans("OoQDIl|!iZzSsbGBgqAT", "00001111122556689947"))
    return re.sub(rf"(?<!\S){re.escape(part)}(?=[\s.,;:?)%]|$)", digits, text) if number_misread(part) else text
