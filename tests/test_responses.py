"""Whole responses: summaries, plain rows, errors, and the reranker that the environment names."""

import pytest
from pyspark.sql import functions as F

from quern.functions import render
from quern.functions import text as T
from quern.operators import corpus, evaluate, rerank, search
from tests.test_engine import engine, source, texts  # noqa: F401


def one(spark, text):
    return spark.createDataFrame([(0, text)], "query_id long, text string")


def test_ranked_response(spark, engine):  # noqa: F811
    queries = spark.createDataFrame([(0, "prayer"), (1, " ")], "query_id long, text string")
    got = engine.respond(queries, "keyword", None, 50)
    said = {r["query_id"]: r for r in got.summary.collect()}
    n = got.rows.where("query_id = 0").count()
    assert said[0]["total"] == said[0]["pool_size"] == said[0]["limit"] == n and said[0]["threshold"] is None and not said[0]["reranker_active"]
    assert (said[1]["total"], said[1]["limit"], said[1]["pool_size"], said[1]["matched_words"], said[1]["reranker_status"]) == (0, 50, 0, [], "disabled")
    assert "match_logic" not in got.summary.columns


def test_term_response_has_words_and_logic(spark, engine):  # noqa: F811
    got = engine.respond_term(one(spark, "salat"))
    said = got.summary.first()
    assert said["match_logic"] == "and" and ("صلاة", 2) in [tuple(w) for w in said["matched_words"]]
    plain = engine.respond_term(one(spark, "salat"), limit=1, rerank_rows=False)
    assert plain.summary.first()["total"] == 2 and plain.summary.first()["matched_words"][0]["count"] == 2 and plain.rows.count() == 1
    assert plain.rows.first()["matched_words"] == ["صلاة"]
    line = render.summary_lines(plain.summary, plain.rows, "term").first()["line"]
    assert line.startswith("Found 2 text(s) matching the term 'salat'.") and "صلاة (2)" in line and line.endswith("Showing first 1:")
    nothing = engine.respond_term(one(spark, "zzz"), rerank_rows=False)
    assert render.summary_lines(nothing.summary, nothing.rows, "term").first()["line"] == "Nothing found containing a word matching 'zzz'."


def test_plain_rows_have_snippets(spark, engine):  # noqa: F811
    rows = engine.respond_keyword(one(spark, "prayer"), ["virtues"], rerank_rows=False)
    assert [r["snippet"] for r in rows.rows.collect()] == ["Intentions of prayer"] and rows.summary.first()["collections"] == ["virtues"]
    near = engine.respond_semantic(one(spark, "abc"), rerank_rows=False)
    assert near.rows.count() == 6 and all(r["similarity"] is not None and len(r["snippet"]) <= 201 for r in near.rows.collect())
    with pytest.raises(search.SearchError):
        search.Engine(engine.corpus, engine.keyword, engine.terms).respond_semantic(one(spark, "abc"))


def test_environment_names_the_reranker(spark, engine, monkeypatch):  # noqa: F811
    rerank.register(rerank.Reranker("first-word", lambda: rerank.pointwise(lambda query, doc: 0.9 if query in doc.lower() else 0.1), 0.5))
    monkeypatch.setenv("RERANKER_NAME", "first-word")
    got = engine.respond(one(spark, "prayer"), "keyword", None, 2)
    said = got.summary.first()
    assert (said["reranker"], said["reranker_active"], said["threshold"], said["limit"]) == ("first-word", True, 0.5, 2)
    assert got.rows.where("bucket = 'strong'").count() == 2


def test_listwise():
    scorer = rerank.listwise(lambda query, docs: [(i, float(len(d))) for i, d in reversed(list(enumerate(docs)))])
    assert scorer("q", ["a", "bbb", "cc"]) == [1.0, 3.0, 2.0]
    with pytest.raises(ValueError):
        rerank.listwise(lambda query, docs: [(0, 1.0)])("q", ["a", "b"])


def test_record_by_number(spark, engine, source):  # noqa: F811
    dimension = corpus.collection_dimension(spark)
    assert corpus.get(engine.corpus, dimension, "muslim", "375").first()["number"] == "375 a"
    with pytest.raises(search.SearchError) as e:
        corpus.get(engine.corpus, dimension, "muslim", "999999")
    assert e.value.kind == "not_found" and "1 to 4" in render.error_line(e.value)
    with pytest.raises(search.SearchError) as e:
        corpus.get(engine.corpus, dimension, "nowhere", "1")
    assert e.value.kind == "unknown_collection"
    assert [r["bookNumber"] for r in corpus.books(corpus.chapters(source), "muslim").collect()] == ["2", "10", "10"]
    with pytest.raises(search.SearchError) as e:
        corpus.books(corpus.chapters(source), "nowhere")
    assert e.value.kind == "unknown_collection"


def test_citation_names(spark):
    rows = [("alanx", "Sahih Al-An"), ("b", "Sunan"), ("c", "al-Sunan b")]
    got = {r["alias"]: r["slug"] for r in corpus.citation_aliases(spark.createDataFrame(rows, "slug string, english_title string")).collect()}
    assert {"alanx", "anx", "x", "sahihalan", "alan", "an"} <= {a for a, s in got.items() if s == "alanx"}
    assert got["sunan"] == "b" and got["b"] == "c" and "" not in got and got["nawawi"] == "forty"


def test_persian_letters(spark):
    row = spark.createDataFrame([("پژگک",), ("چراغ",)], "w string").select(T.romanised(F.col("w")).alias("r")).collect()
    assert [r["r"] for r in row] == ["pjgk", "chraG"]


def test_close_thresholds_are_told_apart(spark):
    curve = spark.createDataFrame([(0.1, 0.5, 0.5, 0.50001), (0.2, 0.5, 0.5, 0.50002)], "threshold double, macro_precision double, macro_recall double, macro_f1 double")
    assert evaluate.reported(evaluate.best_threshold(curve)).first()["threshold"] == 0.2
    late = spark.createDataFrame([(1.0, 1.0, 1.0, 10.0), (0.0, 0.0, 0.0, 25.0)], "precision double, ndcg double, recall double, latency_ms double")
    assert evaluate.macro(late).first()["mean_latency_ms"] == 17.5
