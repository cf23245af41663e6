"""Critical tokens and quantities in a text, and their precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import text as T

# Currencies, units and number formats that scoring recognises.
CURRENCY = r"[$€£¥₹₩]|USD|EUR|GBP|JPY|KRW"
CODES = r"USD|EUR|GBP|JPY|KRW"
UNIT = r"%|‰|°[cCfF]|bp|bps|kg|g|mg|lb|km|m|cm|mm|h|hr|s|ms|kwh|wh|mb|gb|tb"
WORD_UNIT = r"bp|bps|kg|g|mg|lb|km|m|cm|mm|h|hr|s|ms|kwh|wh|mb|gb|tb"
VALUE = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"

TOKEN = (
    rf"(?iuU)([$€£¥₹₩]|(?<!\w)(?:{CODES})(?!\w)|[+−-](?=\d)|(?<![\w.]){VALUE}(?![\w.])|%|‰|°[cf]|(?<!\w)(?:{WORD_UNIT})(?!\w))"
)
PARTS = rf"(?:([+−-])\s*)?(?:({CURRENCY})\s*)?(?:([+−-])\s*)?({VALUE})(?:\s*({CURRENCY}|{UNIT}))?"
QUANTITY = rf"(?iuU)(?<![\w.])({PARTS})(?![\w.])"


def critical_tokens(text: Column) -> Column:
    """Currencies, codes, signs, numbers and units in reading order, in the relaxed form."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), 1)
    return F.transform(found, lambda t: F.replace(F.lower(F.translate(t, "−–—", "---")), F.lit(" ")))


def quantities(text: Column) -> Column:
    """``sign|currency|value|unit`` of every quantity in reading order; one with two signs is none."""
    whole = F.regexp_extract_all(text, F.lit(QUANTITY), 1)
    part = lambda x, i: F.regexp_extract(x, rf"(?iuU)^{PARTS}$", i)

    def tuple_of(x: Column) -> Column:
        before, currency, after, value, suffix = (part(x, i) for i in range(1, 6))
        is_currency = suffix.rlike(rf"(?i)^(?:{CURRENCY})$")
        return F.when((before != "") & (after != ""), F.lit(None)).otherwise(
            F.concat_ws("|", F.concat(before, after), F.when(currency != "", currency).when(is_currency, suffix).otherwise(""), value, F.when(is_currency, "").otherwise(suffix))
        )

    return F.filter(F.transform(whole, tuple_of), lambda q: q.isNotNull())


def common_items(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one dynamic-programming row at a time."""
    first = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(before: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            diagonal, above, left = F.get(before, j - 1), F.get(before, j), F.element_at(acc, -1)
            return F.array_append(acc, F.when(F.get(b, j - 1) == x, diagonal + 1).otherwise(F.greatest(above, left)))

        steps = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, first, row), -1)


def prf(hits: Column, n_seen: Column, n_reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; empty against empty counts as full agreement."""
    precision = T.ratio(hits, n_seen, F.when(n_reference == 0, 1.0).otherwise(0.0))
    recall = T.ratio(hits, n_reference, F.when(n_seen == 0, 1.0).otherwise(0.0))
    return precision, recall, T.f1(precision, recall)
