"""Problem 3: visually identical text with different characters.

Method: a longest-match transducer over grapheme clusters.  Its mapping is computed once from rules over the Unicode
database (widths, composed accents and syllables, spaces, invisible characters, ligatures, hyphens) plus one table of
look-alike letters, and is rejected if two rules disagree.  One pass over a text rewrites it; a look-alike is only
replaced inside a word that also holds Latin letters, so words wholly in another script stay as they are.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import name_free

#: Letters of other scripts and the Latin letters they look like: Cyrillic capitals and small letters, then Greek ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХ" "аеѕіјорсухһԁԛԝѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ονϲ",
        "ABESIJKMHOPCTYX" "aesijopcyxhdqwv" "ABEZHIKMNOPTYX" "ovc",
        strict=True,
    )
)

_VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0xFFF9, 0xFFFC)}
_INVISIBLE_OTHER = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def mapping() -> dict[str, str]:
    """Every sequence with a plainer usual spelling, and that spelling; raises if two rules disagree."""
    table: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if source == target:
            return
        if table.setdefault(source, target) != target:
            raise ValueError(f"conflicting targets for {source!r}")

    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue  # syllables are composed by rule
        char = chr(code)
        kind = unicodedata.category(char)
        shape = unicodedata.decomposition(char)
        if code in _INVISIBLE_OTHER or (kind == "Cf" and code not in _VISIBLE_FORMAT):
            put(char, "")
        elif kind == "Zs":
            put(char, " ")
        elif shape.startswith(("<wide>", "<narrow>")) or (shape.startswith("<font>") and unicodedata.category(unicodedata.normalize("NFKC", char)[0])[0] in "LN"):
            put(char, unicodedata.normalize("NFKC", char))
        elif 0xFB00 <= code <= 0xFB06:
            put(char, unicodedata.normalize("NFKC", char))
        elif code in (0x2010, 0x2011, 0xFE63):
            put(char, "-")
        elif shape and shape[0] != "<":
            put(unicodedata.normalize("NFD", char), unicodedata.normalize("NFC", char))
            put(char, unicodedata.normalize("NFC", char))
            parts = shape.split()
            if len(parts) == 2:  # a composed base with a further mark
                put("".join(chr(int(x, 16)) for x in parts), unicodedata.normalize("NFC", char))
    return table


def _class(chars: str) -> list[tuple[int, int]]:
    """The ranges of a character class, as (first, last) code points."""
    codes = sorted(set(map(ord, chars)))
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append((codes[i], codes[j]))
        i = j + 1
    return out


def _python(ranges: list[tuple[int, int]]) -> str:
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


class Transducer:
    """The compiled mapping: ``rewrite(text)`` is the one consistent form."""

    def __init__(self) -> None:
        self.table = mapping()
        single = "".join(k for k in self.table if len(k) == 1)
        marks = "".join({k[-1] for k in self.table if len(k) > 1})
        jamo = "".join(map(chr, [*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
        #: What can start or continue a rewritten cluster; texts without any of these are already in form.
        self.trigger = frozenset(single + marks + jamo + "".join(LOOKALIKES))
        self.trie: dict = {}
        for source, target in self.table.items():
            node = self.trie
            for char in source:
                node = node.setdefault(char, {})
            node[""] = target
        inner = _python(_class(single + marks + jamo))
        marked = rf".?[{_python(_class(marks + single))}]+"
        #: Clusters alone, and words as well: a text without look-alikes needs no words.
        self.clusters = re.compile(rf"[ᄀ-ᇿ]+|{marked}", re.DOTALL)
        self.words = re.compile(rf"(?:[^\W_]|[{inner}])+|{marked}", re.DOTALL)
        self.alike = frozenset(LOOKALIKES)
        self.cluster = functools.lru_cache(1 << 16)(self._cluster)
        self.word = functools.lru_cache(1 << 16)(self._word)

    def _longest(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            char = text[i]
            if "ᄀ" <= char <= "ᄒ" and i + 1 < len(text) and "ᅡ" <= text[i + 1] <= "ᅵ":
                code = 0xAC00 + (ord(char) - 0x1100) * 588 + (ord(text[i + 1]) - 0x1161) * 28
                i += 2
                if i < len(text) and "ᆨ" <= text[i] <= "ᇂ":
                    code += ord(text[i]) - 0x11A7
                    i += 1
                out.append(chr(code))
                continue
            node, j, best, end = self.trie, i, None, i
            while j < len(text) and text[j] in node:
                node = node[text[j]]
                j += 1
                if "" in node:
                    best, end = node[""], j
            if best is None:
                out.append(char)
                i += 1
            else:
                out.append(best)
                i = end
        return "".join(out)

    def _cluster(self, text: str) -> str:
        # A removed character can bring a base and its mark together, so a cluster is read until it is stable.
        while (now := self._longest(text)) != text:
            text = now
        return text

    def _word(self, text: str) -> str:
        text = self._cluster(text)
        if any(c.isalpha() and "LATIN" in unicodedata.name(c, "") for c in text):
            text = "".join(LOOKALIKES.get(c, c) for c in text)
        return text

    def _any(self, match: re.Match[str]) -> str:
        text = match.group()
        if text.isascii():
            return text
        return self.word(text) if not self.alike.isdisjoint(text) else self.cluster(text)

    def rewrite(self, text: str) -> str:
        if self.trigger.isdisjoint(text):
            return text
        if self.alike.isdisjoint(text):
            return self.clusters.sub(lambda m: self.cluster(m.group()), text)
        return self.words.sub(self._any, text)


@functools.cache
def transducer() -> Transducer:
    return Transducer()


def suspect(text: Column) -> Column:
    """Whether a text has any character the transducer could change; a test of sizes, with no pattern to run."""
    return F.octet_length(text) > F.char_length(text)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    work = transducer().rewrite
    for batch in batches:
        texts = batch.column("text").to_pylist()
        plain = [work(t) for t in texts]
        keep = pa.array([a != b for a, b in zip(texts, plain)], pa.bool_())
        names = [*batch.schema.names, "canonical"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.string())], names).filter(keep)


def items(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(table_name, instance_id, engine, item, text) of all lines and blocks with text."""
    a = name_free(lines, "instance_id", "engine", "page_number", "source_order", "text").select(
        F.lit("ocr_lines").alias("table_name"), "instance_id", "engine", F.concat_ws(":", "page_number", "source_order").alias("item"), "text"
    )
    b = name_free(blocks, "instance_id", "engine", "block_id", "text").select(
        F.lit("ocr_blocks").alias("table_name"), "instance_id", "engine", F.col("block_id").alias("item"), "text"
    )
    return a.unionAll(b).where("text IS NOT NULL")


def changed(texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (any columns with ``text``) that are not in the consistent form, with ``canonical``."""
    hit = texts.where(suspect(F.col("text")))
    schema = ", ".join(f"`{n}` {t}" for n, t in hit.dtypes) + ", canonical string"
    return hit.mapInArrow(_rewrite, schema)


def odd_items(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(table_name, instance_id, engine, item) of lines and blocks not in the consistent form.

    Null texts are no cases, empty texts are in form, repeated rows count once, extra columns are ignored, and empty
    tables give an empty result.
    """
    return changed(items(lines, blocks)).select("table_name", "instance_id", "engine", "item").distinct()


def canonical_items(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(table_name, instance_id, engine, item, text): every line and block in the one consistent form, once."""
    every = items(lines, blocks)
    plain = every.where(~suspect(F.col("text")))
    odd = every.where(suspect(F.col("text")))
    schema = ", ".join(f"`{n}` {t}" for n, t in odd.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = transducer().rewrite
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([work(t) for t in batch.column(at).to_pylist()], pa.string()))

    return plain.unionAll(odd.mapInArrow(run, schema)).distinct()
