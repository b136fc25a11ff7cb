"""Routers with a deadline, many questions in one plan, and scorers of whole lists."""

import asyncio
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import fusion, rerank, route, search
from tests.test_engine import engine, source, texts  # noqa: F401


def test_slow_routers_are_given_up_in_time():
    async def slow(question):
        await asyncio.sleep(0 if question == "quick" else 30)
        return "keyword", [question]

    def blocking(question):
        time.sleep(0 if question == "quick" else 5)
        return "keyword", [question]

    for router in (slow, blocking):
        start = time.time()
        assert route.ask(router, ["quick", "never", "quick", "never"], 0.3) == [("keyword", ["quick"]), None, ("keyword", ["quick"]), None]
        assert time.time() - start < 3


def test_so_many_calls_at_once():
    now, most, lock = [0], [0], threading.Lock()

    async def counted(question):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        await asyncio.sleep(0.02)
        with lock:
            now[0] -= 1
        return "term", [question, " ", question + " too", "", "third", "fourth"]

    found = route.ask(counted, [f"q{i}" for i in range(20)], 5, 3)
    assert most[0] == 3 and found[7] == ("term", ["q7", "q7 too", "third"])


@pytest.mark.parametrize("said", [None, ("concept", []), ("concept", [" ", ""]), ("concept", None), 7, ("one",), ("a", "b", "c"), ("concept", [3])])
def test_what_is_no_answer(said):
    assert route.ask(lambda q: said, ["x"]) == [None]


def test_failures_of_any_kind_are_no_answer():
    def fails(question):
        raise KeyError(question)

    async def fails_too(question):
        raise OSError(question)

    assert route.ask(fails, ["x"]) == route.ask(fails_too, ["x"]) == [None]


def test_ten_questions_in_one_call(spark, engine):  # noqa: F811
    questions = spark.createDataFrame([(i, f"question {i % 3} of prayer") for i in range(8)] + [(8, ""), (9, None)], "query_id long, text string")

    def router():
        def answer(question):
            if " 1 " in question:
                raise RuntimeError("no")
            return ("keyword" if " 0 " in question else "no such mode"), ["prayer", "fasting"]

        return answer

    found = engine.respond_natural(questions, router, limit=3)
    said = {r["query_id"]: r for r in found.summary.collect()}
    assert [said[i]["fallback"] for i in range(10)] == ["router_failed" if i % 3 == 1 or i > 7 else None for i in range(10)]
    assert [said[i]["mode_hint"] for i in (0, 1, 2)] == ["keyword", "concept", "concept"] and said[0]["variants"] == ["prayer", "fasting"] and said[8]["total"] == 0
    rows = found.rows.select("query_id", "bucket", "rank", "corpus_idx", "score").collect()
    for i, text in ((0, "question 0 of prayer"), (1, "question 1 of prayer"), (2, "question 2 of prayer")):
        one, how = engine.natural(text, router(), limit=3)
        assert sorted(map(tuple, one.select("bucket", "rank", "corpus_idx", "score").collect())) == sorted(tuple(r)[1:] for r in rows if r["query_id"] == i)
        assert how["fallback"] == said[i]["fallback"]
    assert {r["fallback"] for r in engine.respond_natural(questions, None).summary.collect()} == {"llm_unavailable"}


def listed(spark, n, queries=2, seed=0):
    rng = random.Random(seed)
    rows = [(i, f"text {rng.randrange(10_000)}", "c") for i in range(n)]
    corpus = spark.createDataFrame(rows, "corpus_idx long, text string, collection string")
    pool = spark.createDataFrame([(q, i, p + 1) for q in range(queries) for p, i in enumerate(rng.sample(range(n), n))], "query_id long, corpus_idx long, place int")
    return corpus, pool, spark.createDataFrame([(q, "same question") for q in range(queries)], "query_id long, text string"), {i: int(t.split()[1]) for i, t, _ in rows}


def by_rank():
    """Scores that only a whole window gives: the share of its texts with a smaller number."""

    def scores(query, docs):
        numbers = [int(d.split()[-1]) for d in docs]
        return [sum(o < x for o in numbers) / len(numbers) for x in numbers]

    return scores


@pytest.mark.parametrize("records", ["3", "1000"])
def test_a_whole_list_is_ordered_alike_under_any_batch_size(spark, records):
    corpus, pool, queries, number = listed(spark, 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        scored = rerank.model_scores(pool, corpus, queries, rerank.Reranker("list", by_rank, window=40)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for q in (0, 1):  # two queries of one text are two lists
        own = sorted((r for r in scored if r["query_id"] == q), key=lambda r: r["place"])
        assert [number[r["corpus_idx"]] for r in own] == sorted(number.values(), reverse=True)
        assert [r["place"] for r in own] == [*range(1, 41)] and all(a["score"] >= b["score"] for a, b in zip(own, own[1:], strict=False))


def test_overlapping_windows_bring_the_best_from_the_last_place_to_the_first(spark):
    corpus, _, queries, number = listed(spark, 60, 1)
    worst_first = sorted(number, key=lambda i: (number[i], i))
    pool = spark.createDataFrame([(0, i, p + 1) for p, i in enumerate(worst_first)], "query_id long, corpus_idx long, place int")
    scored = rerank.model_scores(pool, corpus, queries, rerank.Reranker("list", by_rank, window=10, step=4)).orderBy("place").collect()
    best = sorted(number.values(), reverse=True)
    assert [number[r["corpus_idx"]] for r in scored][:6] == best[:6]  # what a window hands on: 10 - 4 texts
    assert sorted(r["corpus_idx"] for r in scored) == sorted(number)
    split = fusion.split(spark.createDataFrame(scored), 5, 0.0).orderBy("rank").collect()
    assert [r["corpus_idx"] for r in split] == [r["corpus_idx"] for r in scored]


def test_windows_hold_no_more_texts_than_they_are_wide(spark):
    corpus, pool, queries, _ = listed(spark, 33, 1)

    def narrow():
        def scores(query, docs):
            assert len(docs) <= 7
            return [0.5] * len(docs)

        return scores

    scored = rerank.model_scores(pool, corpus, queries, rerank.Reranker("list", narrow, window=7)).collect()
    place = {r["corpus_idx"]: r["place"] for r in pool.collect()}
    assert all(r["place"] == place[r["corpus_idx"]] for r in scored)  # ties keep the order that was there


def test_a_scorer_that_leaves_texts_out_falls_back(spark, engine):  # noqa: F811
    short = rerank.Reranker("short", lambda: lambda query, docs: [1.0], window=4)
    _, how = engine.search("prayer", "keyword", reranker=short)
    assert how["reranker_status"] == "fell_back: ValueError"


def test_every_search_takes_the_configured_reranker(spark, engine, monkeypatch):  # noqa: F811
    rerank.register(rerank.Reranker("by list", by_length, 0.0, window=50))
    monkeypatch.setenv("RERANKER_NAME", "by list")
    assert engine.search("prayer", "keyword")[1]["reranker"] == "by list"
    assert engine.natural("prayer", None)[1]["reranker"] == "by list"
    questions = spark.createDataFrame([(0, "prayer")], "query_id long, text string")
    assert engine.respond_natural(questions, None).summary.first()["reranker"] == "by list"
    assert engine.respond(questions, "keyword").summary.first()["reranker_active"]
    monkeypatch.setenv("RERANKER_DISABLED", "1")
    assert engine.search("prayer", "keyword")[1]["reranker_status"] == "disabled"


def by_length():
    return lambda query, docs: [1.0 / (1 + len(d)) for d in docs]


def test_search_ends(engine):  # noqa: F811
    assert isinstance(engine, search.Engine)
    assert engine.natural("", lambda q: ("term", ["prayer"]))[0].count() > 0
    assert engine.respond(engine.queries(" "), "concept").rows.count() == 0
    assert engine.respond(engine.queries("prayer"), "keyword", limit=0).summary.first()["limit"] == 1
    assert engine.respond(engine.queries("prayer"), "keyword", limit=10**9).rows.where(F.col("bucket") == "weak").count() == 0
