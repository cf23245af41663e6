"""Text normalisation and edit distances as column functions."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# The blanks that strict normalisation turns into one space.
HORIZONTAL_BLANKS = r"[ \t\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"

SCRIPT = ArrayType(
    StructType()
    .add("operation", StringType()).add("left_start", IntegerType()).add("left_end", IntegerType()).add("left_text", StringType())
    .add("right_start", IntegerType()).add("right_end", IntegerType()).add("right_text", StringType())
)


def _per_value(form: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(form, na_action="ignore")

    return run


_nfc = _per_value(lambda s: s if s.isascii() else unicodedata.normalize("NFC", s))
_nfkc = _per_value(lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s))
_folded = _per_value(lambda s: unicodedata.normalize("NFKC", s).casefold())


def collapse_blanks(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strict_text(text: Column) -> Column:
    """NFC, one kind of line break, runs of horizontal blanks as one space; nothing is trimmed."""
    breaks = F.regexp_replace(_nfc(text), r"\r\n?", "\n")
    return F.regexp_replace(breaks, HORIZONTAL_BLANKS, " ")


def line_text(text: Column) -> Column:
    """NFC with every line collapsed and stripped, and no blank lines at the ends."""
    breaks = F.regexp_replace(_nfc(text), r"\r\n?", "\n")
    lines = F.transform(F.split(breaks, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)[^\S\n]+", " "), "^ +| +$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def compatible_text(text: Column) -> Column:
    """NFKC with white space collapsed."""
    return collapse_blanks(_nfkc(text))


def relaxed_text(text: Column) -> Column:
    """NFKC, case folded, dashes as hyphens, white space collapsed."""
    return collapse_blanks(F.translate(_folded(text), "−–—", "---"))


def without_punctuation(text: Column) -> Column:
    """The compatible form without any punctuation character."""
    return F.regexp_replace(compatible_text(text), r"\p{P}", "")


def words(text: Column) -> Column:
    """Words between white space, in order; none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def char_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b))


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in words: each distinct word of the pair becomes one character.

    Exact below 20 000 distinct words a pair; beyond, the private-use planes are reached in the same way.
    """
    known = F.array_union(a, b)
    symbol = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x4DFF), 4, "0")), "UTF-16BE")
    as_text = lambda x: F.array_join(F.transform(x, symbol), "")
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(as_text(a), as_text(b)))


def similarity(distance: Column, n_a: Column, n_b: Column) -> Column:
    """One minus the distance over the longer length; two empty texts are equal."""
    longer = F.greatest(n_a, n_b)
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - distance / longer)


def error_rate(distance: Column, n_reference: Column, n_seen: Column) -> Column:
    """Distance over the reference length; against an empty reference 0 if nothing was seen, else 1."""
    return F.when(n_reference == 0, F.when(n_seen == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(distance / n_reference)


def ratio(numerator: Column, denominator: Column, empty: Column | float) -> Column:
    """A quotient with a stated value for an empty denominator."""
    return F.when(denominator == 0, empty if isinstance(empty, Column) else F.lit(float(empty))).otherwise(numerator / denominator)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def difference_category(query: Column, recovered: Column, other: Column) -> Column:
    """How a query differs from its recovered form, the mildest explanation first."""
    return (
        F.when(query == recovered, "exact")
        .when(compatible_text(query) == compatible_text(recovered), "line_break_or_whitespace")
        .when(collapse_blanks(without_punctuation(query)) == collapse_blanks(without_punctuation(recovered)), "punctuation")
        .when(compatible_text(recovered) != compatible_text(other), "ocr")
        .otherwise("actual_content_difference")
    )


@F.pandas_udf(SCRIPT)
def char_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edit script between two texts, equal stretches left out."""

    def script(x: str | None, y: str | None) -> list | None:
        if x is None or y is None:
            return None
        steps = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return [(op, i, j, x[i:j], k, m, y[k:m]) for op, i, j, k, m in steps if op != "equal"]

    return pd.Series([script(x, y) for x, y in zip(a, b)])
