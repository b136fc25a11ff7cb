"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup, html_extract, mixing, ngram_join, order_minhash, packing, pii, quality, secrets, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, digest string, bucket string, hash string, kept string, mix_size string, score string"
WORDS = [f"word{i % 97}x{i % 13}" for i in range(4000)]
LONG = " ".join(WORDS) * 12  # about 450 KB
SAME = " ".join(f"same{i}" for i in range(60))


def rows():
    texts = [(1, SAME), (2, SAME), (2, SAME), (3, SAME.upper()), (4, None), (5, ""), (6, "   \n\t "), (None, SAME), (None, None), (7, LONG), (8, "short"), (9, "Ünïcödé 👍 text, naïve " * 8), (-5, SAME + " tail"), (10, "two words")]
    return [(i, t, "en", [None, "b", "a"][k % 3], len(t or ""), "r", "n", "d", "b", "h", "k", "m", "s") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, None, 0), (None, 1, 1), (7, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "substring": lambda s, d: substring_dedup.cut(d),
    "mixing": lambda s, d: mixing.draws(d),
    "join": lambda s, d: ngram_join.similar_groups(d),
    "packing": lambda s, d: packing.pack(d),
    "pii": lambda s, d: pii.scan(d),
    "quality": lambda s, d: quality.scored(d, quality.train(d, labels(s))),
    "secrets": lambda s, d: secrets.scan(d),
    "minhash": lambda s, d: order_minhash.neighbours(d),
    "exact": lambda s, d: exact_dedup.exact_groups(d),
    "html": lambda s, d: html_extract.main_text(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "row", "name")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "packing"])
def test_one_row_for_each(spark, nasty, name):
    found = OPERATORS[name](spark, nasty).collect()
    assert len(found) == len(rows())


def test_packing_takes_every_row(spark, nasty):
    found = packing.pack(nasty).collect()
    assert sum(r["piece"] == 0 for r in found) == len(rows())
    assert max(r["length"] for r in found) <= 1024


def test_exact(spark, nasty):
    found = exact_dedup.exact_groups(nasty).collect()
    same = [r for r in found if r["group_size"] == 5]
    assert len(same) == 5 and {r["keep_id"] for r in same} == {3} and sum(r["kept"] for r in same) == 1
    blank = [r for r in found if r["text_sha256"].startswith("e3b0c442")]
    assert {r["keep_id"] for r in blank} == {5} and len(blank) == 3
    left = exact_dedup.exact_dedup(nasty)
    assert left.columns == nasty.columns
    assert left.count() == len(found) - 4 - 2


def test_exact_repeated_keeper(spark):
    docs = spark.createDataFrame([(9, "a"), (9, "A"), (9, "b"), (1, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"].lower()) for r in exact_dedup.exact_dedup(docs).collect()) == [(9, "a"), (9, "b")]


def test_join(spark, nasty):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(nasty).collect()}
    assert (1, 56, -5) in found and (3, 56, -5) in found and (None, 56, -5) in found and (-5, 57, -5) in found
    assert (4, 0, 4) in found and (6, 0, 6) in found and (8, 1, 8) in found and (None, 0, None) in found


def test_mixing(spark, nasty):
    found = mixing.draws(nasty).collect()
    taken = {}
    for r in found:
        words = sum(x["words"] for x in r["mix_draws"])
        assert words <= 3 * r["mix_size"]
        key = (r["source"], r["mix_target"])
        taken[key] = taken.get(key, 0) + words
    for (_, target), words in taken.items():
        assert abs(words - target) <= 3  # repeated rows share a cut, rounded down


def test_minhash(spark, nasty):
    found = order_minhash.neighbours(nasty).collect()
    assert len({r["fingerprint"] for r in found if r["n_chars"] == len(SAME) and r["doc_id"] in (1, 2)}) == 1
    assert {r["fingerprint"] for r in found if r["n_chars"] == 0} == {""}


def test_pipeline_stages_keep_columns(spark, nasty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, nasty.select("doc_id", "text", "lang", "source", "n_chars"), "").columns == ["doc_id", "text", "lang", "source", "n_chars"]
