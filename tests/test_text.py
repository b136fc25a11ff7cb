"""Text expressions on literal cases."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.fixed import ROMAN_FROM, ROMAN_TO


def one(spark, expression, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expression(*(F.col(n) for n in names)).alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    ("raw", "cls"),
    [
        ("", "ungraded"), (None, "ungraded"), ("Sahih", "sahih"), ("Sahīh", "sahih"), ("Hasan Sahih", "hasan_sahih"), ("Sahih Hasan", "hasan_sahih"), ("Da'if", "daif"), ("Da’if", "daif"), ("Hasan", "hasan"),
        ("Sahih (Darussalam)]", "sahih"), ("[Its isnad is Sahih because of others]", "sahih"), ("Maudu", "maudu"), ("Mauḍū‘", "maudu"), ("Fabricated", "maudu"), ("xyzqq", "ungraded"), ("weak", "daif"),
        ('[{"graded_by": "x", "grade": "Sahīh"}]', "sahih"), ("[{\"grade\": \"Muttafaqun 'alayh\"}]", "sahih"), ('[{"graded_by": "x"}]', "ungraded"), ("[{broken sahih", "sahih"),
    ],
)
def test_grades(spark, raw, cls):
    assert one(spark, T.grade_class, raw) == cls


@pytest.mark.parametrize(("q", "words"), [("dua e qunut", ["dua", "qunut"]), ("youm e arafat", ["youm", "arafat"]), ("  Laylatul  qadr  ", ["laylatul", "qadr"]), ("", []), ("al", ["al"])])
def test_query_words(spark, q, words):
    assert one(spark, T.query_words, q) == words


def test_tokens(spark):
    assert one(spark, T.tokens, "It's a Test—of naïve x tokens 42") == ["it's", "test", "of", "na", "ve", "tokens", "42"]


def test_roman_letters_pair_up():
    assert len(ROMAN_TO) == len(ROMAN_FROM) - 2  # the last two are dropped


@pytest.mark.parametrize(
    ("word", "folds"),
    [("أذان", {"dn", "zn"}), ("زنى", {"zn"}), ("أظن", {"zn"}), ("قنوت", {"qnt"}), ("رمضان", {"rmdn", "rmzn"}), ("صلاة", {"sl", "slh", "slt"})],
)
def test_arabic_skeletons(spark, word, folds):
    assert set(one(spark, T.index_skeletons, word)) == folds


@pytest.mark.parametrize(("word", "folds"), [("azan", {"zn"}), ("dhikr", {"dkr"}), ("Khushoo", {"ks"}), ("aeiou", set()), ("salat", {"slt"})])
def test_query_skeletons(spark, word, folds):
    assert set(one(spark, T.query_skeletons, word)) == folds


def test_arabic_words(spark):
    assert one(spark, T.arabic_words, "قَالَ رَسُولُ، الـلّه x") == ["قال", "رسول", "ال", "له"]


MARKED = '[prematn]قال [narrator id="12" role="first" tooltip="محمد"] أبو\nبكر [/narrator] عن [narrator id="3" role="" tooltip=""]زيد[/narrator] [matn]نص[/matn] [narrator id="x"]'


def test_narrators(spark):
    got = [tuple(n) for n in one(spark, T.narrators, MARKED)]
    assert got == [(0, 12, "first", "محمد", "أبو\nبكر"), (1, 3, "", "", "زيد")]
    assert one(spark, T.narrators, "none") == []


def test_without_markup(spark):
    assert one(spark, T.without_markup, MARKED) == 'قال  أبو\nبكر  عن زيد نص [narrator id="x"]'
    assert one(spark, T.without_markup, None) == ""


@pytest.mark.parametrize(
    ("text", "narrator", "body"),
    [
        ("Narrated X:\n\nBody<p>more", "Narrated X:", "Body\nmore"), (" <p> <p>Narrated Y:\nB", "Narrated Y:", "B"), ("No line end:", "", "No line end:"), ("First line\nsecond", "", "First line\nsecond"),
        ("x" * 201 + ":\nB", "", "x" * 201 + ":\nB"), ("", "", ""), ("N:\na\n\n\n\nb", "N:", "a\n\nb"),
    ],
)
def test_split_narrator(spark, text, narrator, body):
    assert tuple(one(spark, T.split_narrator, text)) == (narrator, body)


def test_snippets(spark):
    text = "a" * 100 + "Needle" + "b" * 100
    assert one(spark, T.snippet, text, "nEEdle") == "…" + "a" * 80 + "Needle" + "b" * 80 + "…"
    assert one(spark, T.snippet, "short Needle here", "needle") == "short Needle here"
    assert one(spark, T.snippet, "z" * 161, "needle") == "z" * 160 + "…"
    assert one(spark, T.snippet, "", "needle") == one(spark, T.snippet, None, "needle") == ""


def test_numbers(spark):
    assert one(spark, T.citation, "375 a", "9") == "375a" and one(spark, T.citation, "272, 273", "9") == "272" and one(spark, T.citation, "", "9") == "9"
    assert one(spark, T.eval_key, " 402 B , 403") == "402 b" and one(spark, T.eval_key, None) == ""


def test_cleaners(spark):
    assert one(spark, T.without_tags, " <b>a</b>\n\n b<br> ") == "a b"
    assert one(spark, T.without_wrappers, '[prematn][narrator id="1"]اسم[/narrator][/prematn]\u200f نص') == "اسم نص"
    assert one(spark, T.grade_tag, " Sahih ") == " — Sahih" and one(spark, T.grade_tag, None) == ""
