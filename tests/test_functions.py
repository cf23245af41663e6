"""Golden values and brute-force comparisons of the column functions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillframe.functions import arithmetic as A
from quillframe.functions import hashing
from quillframe.functions import quantity as Q
from quillframe.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("a,b,want", [("kitten", "sitting", 3), ("🙂🙂", "🙂🙃", 1), ("é", "e", 1), ("", "abc", 3), ("same", "same", 0)])
def test_char_distance(spark, a, b, want):
    assert one(spark, T.char_distance(F.col("a"), F.col("b")), a=a, b=b) == want


def test_word_distance_matches_brute_force(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcdé") for _ in range(rng.randrange(9))], [rng.choice("abcdé") for _ in range(rng.randrange(9))]) for _ in range(200)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>").select("i", T.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r.i: r.d for r in rows} == {i: distance(a, b) for i, (a, b) in enumerate(pairs)}


def test_error_rates(spark):
    rate = lambda d, n, m: one(spark, T.error_rate(F.col("d"), F.col("n"), F.col("m")), d=d, n=n, m=m)
    assert rate(1, 3, 3) == pytest.approx(1 / 3)
    assert rate(0, 0, 0) == 0.0
    assert rate(4, 0, 4) == 1.0
    words = [one(spark, T.word_distance(T.words(F.col("a")), T.words(F.col("b"))), a="one two three", b="one four")]
    assert words == [2]


def test_similarity_of_empty_texts(spark):
    assert one(spark, T.similarity(F.col("d"), F.col("n"), F.col("n")), d=0, n=0) == 1.0


def test_normal_forms(spark):
    text = "Cafe\u0301\u00a0\u2003x\r\ny\r"
    assert one(spark, T.strict_text(F.col("s")), s=text) == "Café x\ny\n"
    assert one(spark, T.compatible_text(F.col("s")), s="Ａ  ﬁ\n²") == "A fi 2"
    assert one(spark, T.relaxed_text(F.col("s")), s="Straße – A") == "strasse - a"
    assert one(spark, T.line_text(F.col("s")), s="\n a  b \n\n c\t\n") == "a b\n\nc"
    assert one(spark, T.without_punctuation(F.col("s")), s="a, “b”!") == "a b"


def test_nfc_is_python_nfc(spark):
    texts = ["e\u0301", "\u1112\u1161\u11ab", "plain", "ñ", "A\u030a"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.strict_text(F.col("s")).alias("n")).collect()
    assert all(r.n == unicodedata.normalize("NFC", r.s) for r in rows)


@pytest.mark.parametrize(
    "a,b,want",
    [("x y", "x y", "exact"), ("x  y", "x y", "line_break_or_whitespace"), ("x, y", "x y", "punctuation"), ("x y", "x z", "ocr")],
)
def test_difference_category(spark, a, b, want):
    assert one(spark, T.difference_category(F.col("a"), F.col("b"), F.lit("other")), a=a, b=b) == want
    if want == "ocr":
        assert one(spark, T.difference_category(F.col("a"), F.col("b"), F.col("b")), a=a, b=b) == "actual_content_difference"


def test_char_diff_rebuilds_the_text(spark):
    rows = spark.createDataFrame([("the cat", "a cart")], "a string, b string").select(F.explode(T.char_diff("a", "b")).alias("s")).select("s.*").collect()
    text, shift = "the cat", 0
    for r in rows:
        text = text[: r.left_start + shift] + r.right_text + text[r.left_end + shift :]
        shift += len(r.right_text) - len(r.left_text)
    assert text == "a cart"


def test_critical_tokens(spark):
    found = one(spark, Q.critical_tokens(F.col("s")), s="Paid $1,200.50 or -3 kg, 12% at 20 °C; USD 4")
    assert found == ["$", "1,200.50", "-", "3", "kg", "12", "%", "20", "°c", "usd", "4"]


def test_token_f1(spark):
    p, r, f = Q.prf(F.col("h"), F.col("s"), F.col("n"))
    row = spark.createDataFrame([(5, 6, 7)], "h int, s int, n int").select(p.alias("p"), r.alias("r"), f.alias("f")).first()
    assert row.f == pytest.approx(10 / 13)
    empty = spark.createDataFrame([(0, 0, 0)], "h int, s int, n int").select(f.alias("f")).first()
    assert empty.f == 1.0


def test_quantities_bind_sign_currency_and_unit(spark):
    assert one(spark, Q.quantities(F.col("s")), s="-$5 then 12 kg then + - 3 and USD 7") == ["-|$|5|", "||12|kg", "|USD|7|"]
    assert one(spark, Q.quantities(F.col("s")), s="12 kg and €7") == ["||12|kg", "|€|7|"]


def test_subsequence_is_ordered(spark):
    lcs = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(Q.common_subsequence(F.col("a"), F.col("b"))).first()[0]
    assert lcs(list("ab"), list("ba")) == 1
    assert lcs(list("abcde"), list("xaced")) == 3
    assert lcs([], list("a")) == 0
    assert lcs(list("a"), []) == 0


def test_multiset_intersection(spark):
    assert spark.createDataFrame([(list("aab"), list("abb"))], "a array<string>, b array<string>").select(Q.common_items(F.col("a"), F.col("b"))).first()[0] == 2


@pytest.mark.parametrize(
    "equation,answer,verifying,want",
    [
        ("6 * 7 = 42", "42", False, True), ("42 = 42", "42", False, False), ("42 + 0 = 42", "42", False, False), ("area 6*7 = 42 boxes", "42", False, True), ("x = 6*7 = 42", "42", False, False),
        ("6 * 7 = 41", "42", False, False), ("84 / 42 = 2", "42", True, True), ("42 * 1 = 42", "42", True, False), ("2 ** 20 = 1048576", "1048576", False, False),
        ("2 ^ 3 = 8", "8", False, True), ("1,000 × 2 = 2,000", "2000", False, True), ("1/0 = 3", "3", False, False), ("__import__('os') = 3", "3", False, False),
        ("6 * 7 = 42", None, False, False), ("6 * 7 = 42", "forty-two", False, False), (None, "42", False, False),
    ],
)
def test_proofs(equation, answer, verifying, want):
    assert bool(A.proofs(equation, answer, verifying)) is want


def test_canonical_form_ignores_order():
    assert A.canonical(A.parse("2 + 3 * 4")) == A.canonical(A.parse("4*3 + 2"))
    assert A.canonical(A.parse("2 - 3")) != A.canonical(A.parse("3 - 2"))


@pytest.mark.parametrize("a,b,want", [("1,200", "1200.0", True), ("x", "X", True), (None, None, True), ("1", None, False), ("1", "2", False), (" 5 ", "5", True)])
def test_same_answer(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(A.same_answer(F.col("a"), F.col("b"))).first()[0] is want


def test_ranked_is_the_global_rank(spark):
    import hashlib

    ids = [f"task_{i:06d}" for i in range(500)]
    out = hashing.ranked(spark.createDataFrame([(i,) for i in ids], "id string"), hashing.text_sha(F.lit("s"), F.col("id")), "id").collect()
    want = sorted(ids, key=lambda i: (hashlib.sha256(f"s\x00{i}".encode()).hexdigest(), i))
    assert {r.id: r["rank"] for r in out} == {i: k for k, i in enumerate(want)}
