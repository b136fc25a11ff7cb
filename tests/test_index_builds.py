"""Index builds shuffle postings once, and read texts once."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from quern.operators import bm25, dense, term
from quern.plans import catalogue


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_in_their_rows(spark):
    texts = ["b a b c'd the the the", "", None, "x", "aa ab aa " * 500]
    found = bm25.counted(spark.createDataFrame(list(enumerate(texts)), "corpus_idx long, text string").repartition(2))
    assert "Exchange" not in _plan(found.postings) and "regexp" not in _plan(found.lengths)
    want = {(i, t): n for i, x in enumerate(texts) for t, n in Counter(w for w in (x or "").split() if len(w) > 1).items()}
    assert {(r["corpus_idx"], r["term"]): r["tf"] for r in found.postings.collect()} == want
    assert {r["corpus_idx"]: r["dl"] for r in found.lengths.collect()} == {0: 4, 1: 0, 2: 0, 3: 0, 4: 1500}


def test_the_term_index_has_a_posting_a_word_and_hits_meet_it_by_word(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(i, f"salat word{i % 7} salaat") for i in range(100)], "corpus_idx long, text string")
    built = term.build(texts, term.T.latin_words, "text")
    assert "Join" not in _plan(built.held)
    built.write(str(tmp_path))
    index, asked = term.Index.read(spark, str(tmp_path)), spark.createDataFrame([(0, "salat"), (1, "word3")], "query_id long, text string")
    few = sorted(map(tuple, term.hits(index, asked).collect()))
    monkeypatch.setattr(term, "MOST_LITERALS", 0)
    assert sorted(map(tuple, term.hits(index, asked).collect())) == few and len(few) > 100
    assert few == sorted(map(tuple, term.hits(built, asked).collect()))


def test_a_search_of_one_leg_builds_no_other_index(spark, monkeypatch):
    def never(*_):
        raise AssertionError("built")

    monkeypatch.setattr(catalogue, "_term_index", never)
    monkeypatch.setattr(catalogue, "bound", lambda s, d: s.createDataFrame([(1, "src1", "en", 1, "1", "licensed text", "", 1, 1)], "corpus_idx long, collection string, book string, id_in_book int, number string, text string, grade string, grade_tier int, tier int").union(s.createDataFrame([(i, f"src{i}", "en", 1, "1", "other", "", 1, 1) for i in (2, 3)], "a long, b string, c string, d int, e string, f string, g string, h int, i int")))
    monkeypatch.setattr(catalogue, "dimension", lambda s, d: s.createDataFrame([("src1", "One")], "slug string, english_title string"))
    monkeypatch.setattr(catalogue, "_BUILT", {})
    assert catalogue.QUERIES["plain_keyword_summary"](spark, "none").agg(F.sum("total")).first()[0] == 1


def test_many_queries_keep_k_rows_a_task(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["the", "and", "with", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rng.choices(words, [40, 30, 20] + [1] * 60, k=rng.randrange(1, 30)))) for i in range(3000)]
    bm25.build(spark.createDataFrame(rows, "corpus_idx long, text string").repartition(3)).write(str(tmp_path))
    index = bm25.Index.read(spark, str(tmp_path))
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=12))) for q in range(40)] + [(99, "nothing"), (98, "")], "query_id long, text string")
    want = sorted(map(tuple, bm25.top(bm25.scores(index, asked), 7).select("query_id", "rank", "corpus_idx", "score").collect()))
    monkeypatch.setattr(bm25, "HELD", 50)
    found = bm25.best(index, asked, 7)
    assert sorted(map(tuple, found.select("query_id", "rank", "corpus_idx", "score").collect())) == want
    assert "HashAggregate" not in _plan(found)
    blocks = catalogue.blockmax.build(index)
    monkeypatch.setattr(bm25, "MOST_LITERALS", 5)
    assert sorted(map(tuple, catalogue.blockmax.top(blocks, asked, 7).select("query_id", "rank", "corpus_idx", "score").collect())) == want


def test_scores_of_every_pair_by_products(spark, monkeypatch):
    monkeypatch.setattr(dense, "PAIRS", 10)
    monkeypatch.setattr(dense, "MOST_QUERIES", 3)
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0, -0.25]) for i in range(23)] + [(50, None), (51, [1.0, None, 2.0]), (52, [1.0])], "corpus_idx long, embedding array<float>")
    asked = spark.createDataFrame([(q, [0.5 * q, 1.0, 2.0]) for q in range(7)] + [(9, None), (8, [1.0])], "query_id long, query array<double>")
    found = dense.scores(rows, asked)
    assert "MapInArrow" in _plan(found)
    want = {(q, i): round(0.5 * q * (i % 5) + 0.5, 6) for q in range(7) for i in range(23)} | {(8, 52): 1.0}
    got = {(r["query_id"], r["corpus_idx"]): r["score"] for r in found.collect()}
    assert len(got) == 26 * 9 == found.count() and {k: v for k, v in got.items() if v is not None} == want


def test_the_pool_is_computed_once(spark):
    import os

    import pytest

    import __spark_entry__ as entry

    if not os.path.isdir(entry.SMOKE_DIR):
        pytest.skip("no tables")
    plan = _plan(catalogue._pool(spark, entry.SMOKE_DIR))
    assert "quern-pool" in plan and "Exchange" not in plan and "Join" not in plan


def test_no_fixed_number_of_tasks_reads_the_corpus_again(spark, monkeypatch):
    from quern.sources import tables

    rows = spark.createDataFrame([(i, "abc z") for i in range(50)], "corpus_idx long, text string")
    plans, plain = [], tables.fingerprint
    monkeypatch.setattr(catalogue, "bound", lambda s, d: rows)
    monkeypatch.setattr(tables, "fingerprint", lambda r, t: plans.append(_plan(r)) or plain(r, t))
    assert catalogue.QUERIES["vectors_round_trip"](spark, "none").count() == 50
    assert "REPARTITION_BY_NUM" not in plans[1] and "REPARTITION_BY_COL" in plans[1]
