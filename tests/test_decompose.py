"""Decomposition over all of Unicode, romanisation of whole blocks, measured latencies."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as T
from quern.functions.decompose import to_ascii
from quern.operators import evaluate, latency


def plain(text):
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def test_every_character_decomposes_as_unicode_says(spark):
    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    rows = [(i, "".join(every[i : i + 64])) for i in range(0, 0x11000, 64)] + [(i, every[i]) for i in range(0x80, 0x3400)]
    rows += [(i, "".join(every[i : i + 512])) for i in range(0x11000, len(every), 512)]
    found = {(r["i"], r["t"]): r["a"] for r in spark.createDataFrame(rows, "i long, t string").withColumn("a", to_ascii(F.col("t"))).collect()}
    assert all(found[i, t] == plain(t) for i, t in rows)


@pytest.mark.parametrize("raw, cls", [("Ṣaḥīḥ", "sahih"), ("𝐒𝐚𝐡𝐢𝐡", "sahih"), ("ﬀ Ｄａ’ｉｆ", "daif"), ("Ⓗⓐⓢⓐⓝ", "hasan"), ("Ḥasan Ṣaḥīḥ", "hasan_sahih"), ("مَوْضُوع", "ungraded"), (None, "ungraded"), ("Mauḍū`", "maudu")])
def test_grades_in_any_letters(spark, raw, cls):
    assert spark.createDataFrame([(raw,)], "raw string").select(T.grade_class(F.col("raw"))).first()[0] == cls


def test_all_arabic_letters_are_spelt(spark):
    letters = [chr(i) for i in [*range(0x621, 0x63B), *range(0x641, 0x64B), *range(0x671, 0x6D4)]]
    found = {r["c"]: r["r"] for r in spark.createDataFrame([(c,) for c in letters], "c string").withColumn("r", T.romanised(F.col("c"))).collect()}
    for i, spelt in enumerate(fixed.ROMAN_EXTENDED):
        c = chr(0x671 + i)
        if c not in fixed.ROMAN_FROM and c not in dict(fixed.ROMAN_PAIRS):
            assert found[c] == spelt.strip("-"), c
    assert [c for c in letters[:36] if not found[c] and c not in "ءعػ"] == [] or all(found[c].isascii() for c in letters)
    assert all(found[c].isascii() for c in letters) and found["ڭ"] == "ng" and found["ڤ"] == "v" and found["ب"] == "b"


def test_skeletons_of_extended_and_latin_letters(spark):
    words = [("ڭورڭان", {"ngrngn"}), ("ڤاتىق", None), ("Straße", {"strs"}), ("Øłđ", {"ld"}), ("ﻢﻜﺔ", None)]
    found = {r["w"]: set(r["s"]) for r in spark.createDataFrame([(w,) for w, _ in words], "w string").withColumn("s", T.query_skeletons(F.col("w"))).collect()}
    assert all(found[w] == s for w, s in words if s is not None)


def test_latencies_of_real_runs(spark):
    frame = spark.range(1000)
    found = latency.measured(spark, [(i, lambda i=i: frame.where(F.col("id") % (i + 2) == 0).repartition(2)) for i in range(3)])
    rows = {r["query_id"]: r for r in found.collect()}
    assert [rows[i]["rows"] for i in range(3)] == [500, 334, 250]
    assert all(r["latency_ms"] > 0 and r["jobs"] >= 1 and r["tasks"] >= 2 and not r["failed_tasks"] for r in rows.values())
    ranked = spark.createDataFrame([(0, 1, 1), (1, 2, 1)], "query_id long, doc long, rank int")
    relevant = spark.createDataFrame([(0, 1), (1, 5)], "query_id long, doc long")
    macro = evaluate.macro(evaluate.per_query(ranked, relevant, ["doc"]).join(found.select("query_id", "latency_ms"), "query_id")).first()
    assert macro["n_queries"] == 2 and macro["mean_latency_ms"] == round((rows[0]["latency_ms"] + rows[1]["latency_ms"]) / 2, 1)
