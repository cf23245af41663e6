"""Problem 4: text cut off by field limits.

Method: a vocabulary trie over the corpus plus length evidence.  One pass counts, over all texts, the words before the
last position, the openings and ends of texts, and numbers that close a sentence.  A text is cut when

* its declared size exceeds what is stored, or its JSON or tags never close;
* it ends in a cut mark or a broken character;
* it is a block without a terminator, as long (in characters or bytes) as a conspicuous number of blocks of its
  engine that break off in running text; behind a full stop such a length decides only together with the trie; so it
  does for outputs that are as long, measured by their ``max_new_tokens``, as many that break off;
* its last token is an unknown proper prefix of known words (the trie, kept as a table of prefixes);
* it ends without a terminator although it is running text: a sentence came before, or texts that open like it do not
  end that way. Headings, table rows and totals have openings and last words that the corpus knows as complete.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.canon import transducer
from quillframe.llm.common import cut, name_free
from quillframe.llm.noise import shape

#: A word seen this often is known; its prefixes make the trie.
KNOWN = 5
#: Texts with the same opening that make it known.
SEEN = 5
#: Bytes a stripped final line break may hide.
SLACK = 2
#: Entries a partition gathers before it hands its counts on.
FLUSH = 400_000

#: A length is a limit if so many blocks of the source break off there in running text, and so many times the usual number.
SPIKE, RISE = 20, 10
#: Lengths on either side that tell the usual number.
AROUND = 8
#: Limits up to which every task gets the whole list; more of them are joined by a shuffle, with the same result.
LISTED = 4_096

_END = r"""[.?!。？！](?:["”’'»“)\]]*)$"""
_ENDED = re.compile(r"[.?!。？！][\"”’'»“)\]]*$")
_INNER = re.compile(r"[^\W\d][.?!。？！][\"”’'»“)\]]*\s|\d[.?!]\s+[^\W\d_]")
_MARK = re.compile(r"(?:…|\.\.+|\[[^\w\]]*\]|\([^\w)]*\)|\[(?:cut|truncated|more)\]|\((?:cut|truncated|more)\)|�)$", re.I)
_WORD = re.compile(r"[^\W\d_]{2,}")
#: A word that no break mark follows, so that the first part of a broken word is none.
_WHOLE = re.compile(r"[^\W\d_]{2,}+(?![-¬~=‐])")
_POINT = re.compile(r"(\S+)\s+\d[\d,]*(\.\d*)(?=\s)")


def tidy(text: str) -> str:
    """The text in the one consistent form of problem 3, without blanks at its end."""
    return (text if text.isascii() else transducer().rewrite(text)).rstrip()


def opening(tokens: list[str]) -> str:
    return " ".join(shape(t) for t in tokens[:2]) if len(tokens) > 1 else f"{shape(tokens[0])} <end>"


def layout(tokens: list[str]) -> str:
    """The row layout of a text with columns or a label: kinds of all tokens, hashed if many; empty for plain words."""
    kinds = ["#" if shape(t) == "#" else t if not any(c.isalnum() for c in t) else "w:" if t.endswith(":") else "w" for t in tokens]
    if not any(k in ("w:", "|") for k in kinds):
        return ""
    row = " ".join(kinds)
    return row if len(kinds) <= 12 else hashlib.blake2b(row.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def closed(text: str) -> bool | None:
    """Whether a JSON or tagged text is complete; None for a plain text."""
    head = text.lstrip()
    if head[:1] in "{[" and re.match(r"[{\[]\s*[\"{\[\]}]", head):
        try:
            json.loads(head)
            return True
        except ValueError:
            return False
    if m := re.match(r"<([A-Za-z][\w-]*)[^<>]*>", head):
        return head.rstrip().endswith(f"</{m.group(1)}>")
    return None


def last_block(text: str) -> str | None:
    """The text of the last labelled line of a plain output, without its label; None if only (part of) a label is there."""
    head, _, line = text.rstrip("\n").rpartition("\n")
    if head and re.fullmatch(r"\W?[bB]\w{0,3}\W*", line) and re.match(r"\W?[bB]\d{1,3}\W", head):
        return None
    return re.sub(r"^\W?[bB]\w{1,3}\W+(?=\S)", "", line, count=1) if re.match(r"^\W?[bB]\d{1,3}\W", line) else line


def texts_of(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """(table_name, instance_id, source, item, text, declared, most): everything that can be cut, repeated rows included;
    ``most`` is the number of tokens an output was allowed."""
    a = name_free(blocks, "instance_id", "engine", "block_id", "text").where("text IS NOT NULL").select(
        F.lit("ocr_blocks").alias("table_name"), "instance_id", F.col("engine").alias("source"), F.col("block_id").alias("item"), "text", F.lit(None).cast("long").alias("declared"), F.lit(None).cast("int").alias("most")
    )
    if "max_new_tokens" not in results.columns:
        results = results.withColumn("max_new_tokens", F.lit(None).cast("int"))
    b = name_free(results, "instance_id", "name", "model_index", "status", "raw_output", "raw_output_bytes", "max_new_tokens")
    b = b.where("raw_output IS NOT NULL AND coalesce(status, 'ok') != 'failed'").select(
        F.lit("results").alias("table_name"), "instance_id", F.col("name").alias("source"), F.col("model_index").cast("string").alias("item"),
        F.col("raw_output").alias("text"), F.col("raw_output_bytes").cast("long").alias("declared"), F.col("max_new_tokens").cast("int").alias("most"),
    )
    return a.unionAll(b)


def length_keys(text: str, source: str | None) -> list[str]:
    """The lengths of a text with their unit; an ASCII text has one, any other one in characters and one in bytes."""
    if text.isascii():
        return [f"ascii\t{source or ''}\t{len(text)}"]
    return [f"chars\t{source or ''}\t{len(text)}", f"bytes\t{source or ''}\t{len(text.encode('utf-8', 'surrogatepass'))}"]


def token_key(text: str, source: str | None, most: int | None) -> list[str]:
    """The length of an output in quarters of a character per token it was allowed."""
    return [f"tokens\t{source or ''}\t{len(text) * 4 // most}"] if most and most > 0 else []


def limits(counts: DataFrame) -> DataFrame:
    """(length_key) of all lengths at which far more blocks break off in running text than at the lengths around.
    Headings of one form may share a length as well, so they show no limit by themselves.
    """
    part = F.split("key", "\t")
    own = counts.where("kind = 'length' AND open > 0").select("key", "open", part[0].alias("unit"), part[1].alias("source"), F.element_at(part, -1).cast("long").alias("length"))
    near = Window.partitionBy("unit", "source").orderBy("length").rangeBetween(-AROUND, AROUND)
    usual = (F.sum("open").over(near) - F.col("open")) / (2 * AROUND)
    high = own.withColumn("usual", usual).where((F.col("open") >= SPIKE) & (F.col("open") >= RISE * F.col("usual")))
    return high.select(F.col("key").alias("length_key"))


def at_limit(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` with ``limit``: whether a text has one of the lengths in ``keys``, of which there is any number."""
    chars, size = F.length("text"), F.octet_length("text")
    key = lambda unit, n: F.concat_ws("\t", unit, F.coalesce("source", F.lit("")), n.cast("string"))
    block, plain = F.col("table_name") == "ocr_blocks", chars == size
    told = F.when(F.col("most") > 0, key(F.lit("tokens"), F.floor(chars * 4 / F.col("most"))))
    first = F.when(block, key(F.when(plain, "ascii").otherwise("chars"), chars)).otherwise(told)
    keys = cut(keys.withColumn("hit", F.lit(True)))
    known = F.broadcast(keys) if keys.count() <= LISTED else keys
    columns = texts.columns
    # A text that is not ASCII has a second length, in bytes.
    for length_key, hit in ((first, "hit_first"), (F.when(block & ~plain, key(F.lit("bytes"), size)), "hit_second")):
        texts = _looked_up(texts.withColumn("length_key", length_key), known.withColumnRenamed("hit", hit), "length_key").drop("length_key")
    return texts.select(*columns, F.coalesce("hit_first", "hit_second", F.lit(False)).alias("limit"))


def counted(texts: DataFrame) -> DataFrame:
    """(kind, key, n, open): the corpus counts, as one table.

    ``word``: words before the last token, with their number. ``start``: openings of block texts (two words, the
    first, the second), with the number of texts and of those that are one piece without terminator. ``end``: opening word and last word of such pieces.
    ``length``: unit, source and length of blocks and outputs, with the number of those that are running text
    without terminator. ``size``: opening word and number of words
    of such pieces. ``layout``: their row layouts. ``point`` and ``decimal``: words before a number that closes a sentence within
    a text, and before a number with decimals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word: Counter[str] = Counter()
        other: Counter[tuple[str, str]] = Counter()
        bare: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kinds = ["word"] * len(word) + [k for k, _ in other]
            keys = [*word, *(k for _, k in other)]
            n = [*word.values(), *other.values()]
            open_ = [0] * len(word) + [bare[k] if kind in ("start", "length") else 0 for kind, k in other]
            word.clear(), other.clear(), bare.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array(open_, pa.int64())], ["kind", "key", "n", "open"])

        for batch in batches:
            for table_name, text, source, most in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if table_name == "results":
                    for key in token_key(text, source, most):
                        other["length", key] += 1
                        bare[key] += closed(text) is False or (closed(text) is None and not _ENDED.search(text.rstrip()))
                lengths = length_keys(text, source) if table_name == "ocr_blocks" else []
                text = tidy(text)
                body, _, _ = text.rpartition(" ")
                word.update(_WHOLE.findall(body))
                for m in _POINT.finditer(text):
                    other["point" if m.group(2) == "." else "decimal", shape(m.group(1))] += 1
                if table_name == "ocr_blocks":
                    tokens = text.split()
                    ended, inner = bool(_ENDED.search(text)), bool(_INNER.search(text))
                    for key in lengths:
                        other["length", key] += 1
                        bare[key] += inner and not ended
                    if tokens:
                        key = opening(tokens)
                        second = f"* {shape(tokens[1])}" if len(tokens) > 1 else "* <end>"
                        other["start", key] += 1
                        other["start", second] += 1
                        first = f"{shape(tokens[0])} *"
                        other["start", first] += 1
                        if not ended and not inner and not _MARK.search(text):
                            bare[key] += 1
                            bare[second] += 1
                            bare[first] += 1
                            other["size", f"{shape(tokens[0])} {len(tokens)}"] += 1
                            if row := layout(tokens):
                                other["layout", row] += 1
                            other["end", f"{shape(tokens[0])} {shape(tokens[-1])}"] += 1
            if len(word) > FLUSH:
                yield flush()
        yield flush()

    partial = texts.select("table_name", "text", "source", "most").mapInArrow(run, "kind string, key string, n long, open long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("open").alias("open"))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: what it shows by itself, and the keys under which the corpus knows the rest."""
    names = ["table_name", "instance_id", "source", "item"]
    for batch in batches:
        rows: list[tuple] = []
        keep = []
        # What makes a row certain is named; the first evidence that holds counts.
        for i, (table_name, text, declared, limit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("table_name", "text", "declared", "limit")))):
            certain = "declared size" if declared is not None and declared > len(text.encode("utf-8", "surrogatepass")) + SLACK else None
            piece = text
            if table_name == "results" and not certain:
                whole = closed(text)
                if whole is True:
                    continue
                piece = last_block(text)
                certain = "never closed" if whole is False or piece is None else None
            piece = tidy(piece or "")
            tokens = piece.split()
            if not tokens and not certain:
                continue
            ended = bool(_ENDED.search(piece))
            marked = bool(_MARK.search(piece))
            point, stopped = None, False
            if ended and not marked and not certain:
                m = re.search(r"(\S+)\s+\d[\d,]*\.$", piece)
                stopped = limit and not m
                if not m and not stopped:
                    continue
                point = shape(m.group(1)) if m else None
            if not certain and marked:
                certain = "cut mark"
            elif not certain and not ended and limit and table_name == "ocr_blocks":
                certain = "length limit"
            elif not certain and not ended and _INNER.search(piece):
                certain = "sentence before"
            final = _ENDED.sub("", tokens[-1]) if stopped else tokens[-1] if tokens else ""
            last = _WORD.findall(final)[-1] if _WORD.search(final) else ""
            keep.append(i)
            second = f"* {shape(tokens[1])}" if len(tokens) > 1 else "* <end>"
            first = f"{shape(tokens[0])} *" if tokens else ""
            rows.append((certain, bool(limit), stopped, point, opening(tokens) if tokens else "", first, second, layout(tokens), len(tokens), f"{shape(tokens[0])} {len(tokens)}" if tokens else "", f"{shape(tokens[0])} {shape(tokens[-1])}" if tokens else "", last if final.endswith(last) else ""))
        head = [batch.column(n).take(pa.array(keep, pa.int64())) for n in names]
        types = (pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        tail = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(head + tail, [*names, "certain", "limit", "stopped", "point", "start_key", "first_key", "second_key", "layout", "size", "size_key", "end_key", "last"])


def prefixes(words: DataFrame) -> DataFrame:
    """The trie as a table: (prefix) of every known word, without the word itself."""
    known = words.where(F.col("n") >= KNOWN)
    spread = known.select("key", F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("size")).select(F.substring(F.col("key"), F.lit(1), F.col("size")).alias("prefix"))
    return spread.distinct()


def _looked_up(rest: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rest`` with the columns of ``table`` for its ``key``. Most texts lack some keys; those get keys of their own that
    no table holds, so that they do not all meet in one task."""
    own = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("instance_id", "source", "item"), F.lit(65_536)).cast("string"))
    return rest.withColumn(key, F.when(F.coalesce(F.col(key), F.lit("")) == "", own).otherwise(F.col(key))).join(table, key, "left")


def judged(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """(table_name, instance_id, source, item) of every cut text, see :func:`judged_by`."""
    return judged_by(blocks, results).select("table_name", "instance_id", "source", "item").distinct()


def judged_by(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """(table_name, instance_id, source, item, evidence) of every cut text, with the evidence that decided.

    Null texts and failed rows are no cases; an empty text is complete unless its declared size is larger; a text with
    several rows is cut if one of them is; extra columns are ignored; empty tables give an empty result.
    """
    texts = texts_of(blocks, results)
    counts = cut(counted(texts))
    schema = "table_name string, instance_id string, source string, item string, certain string, limit boolean, stopped boolean, point string, start_key string, first_key string, second_key string, layout string, size int, size_key string, end_key string, last string"
    # Texts that end in a full stop after a word need no judging, unless they are JSON or tags, or as long as a limit.
    texts = at_limit(texts, limits(counts))
    open_end = ~F.col("text").rlike(r"[^\W\d_][.?!][\"”’'»“)\]]*\s*$") | (F.col("table_name") == "results") | F.col("limit")
    facts = cut(texts.where(open_end).mapInArrow(_facts, schema))
    sure = facts.where("certain IS NOT NULL").withColumn("evidence", F.col("certain"))
    rest = facts.where("certain IS NULL").withColumn("first", F.substring_index("end_key", " ", 1))
    start = counts.where("kind = 'start'").select(F.col("key").alias("start_key"), F.col("n").alias("start_n"), "open")
    ends = counts.where("kind = 'end'").select("key", "n", F.substring_index("key", " ", 1).alias("first"))
    most = ends.groupBy("first").agg(F.max("n").alias("most"), F.sum("n").alias("pieces"))
    second = start.select(F.col("start_key").alias("second_key"), F.col("start_n").alias("second_n"), F.col("open").alias("second_open"))
    first = start.select(F.col("start_key").alias("first_key"), F.col("start_n").alias("first_n"), F.col("open").alias("first_open"))
    sizes = counts.where("kind = 'size'").select(F.col("key").alias("size_key"), F.col("n").alias("size_n"))
    rows = counts.where("kind = 'layout'").select(F.col("key").alias("layout"), F.col("n").alias("layout_n"))
    usual = rows.agg(F.max("layout_n")).first()[0] or 0
    end = ends.select(F.col("key").alias("end_key"), F.col("n").alias("end_n"))
    point = counts.where("kind = 'point'").select(F.col("key").alias("point"), F.col("n").alias("point_n"))
    decimal = counts.where("kind = 'decimal'").select(F.col("key").alias("point"), F.col("n").alias("decimal_n"))
    word = counts.where("kind = 'word'")
    trie = prefixes(word).withColumn("grows", F.lit(True))
    words = word.select(F.col("key").alias("last"), F.col("n").alias("last_n"))
    points = point.join(decimal, "point", "full_outer")
    rest = rest.withColumn("has_point", F.col("point").isNotNull()).withColumn("has_layout", F.length("layout") > 0).withColumn("has_last", F.length("last") > 0)
    for table, key in ((most, "first"), (start, "start_key"), (end, "end_key"), (points, "point"), (first, "first_key"), (second, "second_key"), (sizes, "size_key"), (rows, "layout"), (words, "last"), (trie.withColumnRenamed("prefix", "last"), "last")):
        rest = _looked_up(rest, table, key)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    unknown_prefix = F.col("has_last") & F.coalesce("grows", F.lit(False)) & (n("last_n") < KNOWN)
    # An opening that the corpus hardly knows (a name, a misread word) is judged by its first word, its second, its length.
    heading = (
        F.when(n("start_n") >= SEEN, n("open") >= 0.6 * n("start_n"))
        .when(n("first_n") >= SEEN, n("first_open") >= 0.6 * n("first_n"))
        .when((n("second_n") >= SEEN) & (F.col("second_key") != "* <end>"), n("second_open") >= 0.6 * n("second_n"))
        .otherwise((F.col("size") < 5) & (F.col("size") > 1))
    )
    row = F.col("has_layout") & (n("layout_n") >= F.greatest(F.lit(2), F.lit(0.005 * usual)))
    # Headings that end in a name end in too many words to know each; there the usual number of words has to do.
    named = (n("most") <= F.greatest(F.lit(2), 0.015 * n("pieces"))) & (n("size_n") >= 0.2 * n("pieces"))
    complete = (n("end_n") >= F.greatest(F.lit(2), 0.02 * n("most"))) | (n("most") < 10) | row | named
    running = F.when(F.col("stopped"), unknown_prefix).otherwise(~F.col("has_point") & (~heading | unknown_prefix | ~complete))
    broken_number = F.col("has_point") & (n("point_n") < 2) & (n("decimal_n") >= SEEN)
    evidence = (
        F.when(unknown_prefix & F.col("limit"), "trie and length").when(unknown_prefix, "trie").when(broken_number, "broken number")
        .when(F.col("limit"), "length and opening").when(~heading, "opening").otherwise("ending")
    )
    flagged = rest.where(running | broken_number).withColumn("evidence", evidence)
    keys = ["table_name", "instance_id", "source", "item", "evidence"]
    return sure.select(*keys).unionAll(flagged.select(*keys))


def evidence_report(cases: DataFrame) -> DataFrame:
    """(table_name, evidence, n_cut): how many cut texts each kind of evidence decided."""
    one = cases.groupBy("table_name", "instance_id", "source", "item").agg(F.min("evidence").alias("evidence"))
    return one.groupBy("table_name", "evidence").agg(F.count("*").alias("n_cut"))


def cut_share(blocks: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """(table_name, source, n_texts, n_cut, share): the share of cut records per engine or model name."""
    keys = ["table_name", "instance_id", "source", "item"]
    every = texts_of(blocks, results).select(*keys).distinct()
    joined = every.join(cases.withColumn("cut", F.lit(1)), [every[k].eqNullSafe(cases[k]) for k in keys], "left").select(every["table_name"], every["source"], "cut")
    out = joined.groupBy("table_name", "source").agg(F.count("*").alias("n_texts"), F.count("cut").alias("n_cut"))
    share: Column = F.round(F.col("n_cut") / F.col("n_texts"), 6)
    return out.withColumn("share", share)
