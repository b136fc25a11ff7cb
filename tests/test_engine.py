"""Lookups, legs, fusion, reranking and natural search on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import render
from quern.operators import bm25, corpus, dense, evaluate, fusion, rerank, search, term
from quern.sources.dump import SOURCE


def source_row(collection, book, bab, number, urn, text="", arabic="", grade="", chapter=None):
    return (collection, book, bab, None, None, number, None, urn, None, arabic, "", urn + 10_000, chapter, text, grade, None, "")


ROWS = [
    source_row("muslim", "2", 1.0, "375 b", 5, "Narrated A:\nThe second variant of prayer", "صلاة", "Sahih", "On Prayer"),
    source_row("muslim", "2", 1.0, "375 a", 6, "Narrated A:\nThe first variant of prayer", "قنوت صلاة", "Hasan", "On Prayer"),
    source_row("muslim", "10", 1.5, "272, 273", 7, "Fasting in the month", "رمضان", "Sahih", " "),
    source_row("muslim", "10", 2.0, "402b", 8, "Prayer and fasting, prayer again", "دعاء قنوت", "", "Fasting"),
    source_row("bukhari", "1", 1.0, "1", 1, "Deeds are by intentions", "نية", "Sahih", "Revelation"),
    source_row("bukhari", "1", None, "402b", 2, None, None, "Maudu", None),
    source_row("virtues", "1", 1.0, "", 9, "Intentions of prayer", "أذان", "Da'if", "prayer"),
]


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(ROWS, SOURCE)


@pytest.fixture(scope="module")
def texts(source):
    return corpus.build(source).persist()


@pytest.fixture(scope="module")
def engine(spark, texts):
    vectors = spark.createDataFrame([(r["corpus_idx"], [1.0, float(r["corpus_idx"])]) for r in texts.collect()], "corpus_idx long, embedding array<double>")
    unit = vectors.withColumn("embedding", F.transform("embedding", lambda x: x / F.sqrt(F.lit(1.0) + F.col("corpus_idx") ** 2)))
    return search.Engine(texts, bm25.build(texts), term.build(texts), unit, lambda q: [[1.0, float(len(x))] for x in q], corpus.collection_dimension(spark))


def test_corpus(texts):
    got = {r["global_id"]: r for r in texts.collect()}
    # collections in their order, books as numbers, then chapter and row
    assert [got[i]["corpus_idx"] for i in (2, 1, 5, 6, 7, 8, 9)] == list(range(7))
    assert got[5]["id_in_book"] == 1 and got[8]["id_in_book"] == 4 and got[5]["narrator"] == "Narrated A:" and got[5]["text"] == "The second variant of prayer"
    assert got[2]["text"] == "" and got[2]["arabic"] == "" and got[2]["grade_tier"] == 5 and got[7]["chapter_id"] == 1 and got[2]["chapter_id"] is None


def test_chapters(source):
    got = {(r["collection"], r["bookNumber"], r["babID"]): r["english_title"] for r in corpus.chapters(source).collect()}
    assert got["muslim", "2", 1.0] == "On Prayer" and got["muslim", "10", 1.5] == "" and len(got) == 6


def test_lookup(spark, texts):
    keys = [(1, "muslim", "375A"), (2, "muslim", "375"), (3, "muslim", "273"), (4, "muslim", " 402 b "), (5, "bukhari", "402b"), (6, "muslim", "3"), (7, "muslim", "999999"), (8, "muslim", ""), (9, "none", "1"), (10, "virtues", "1")]
    got = {r["key_id"]: (r["rule"], r["global_id"]) for r in corpus.lookup(texts, spark.createDataFrame(keys, "key_id long, collection string, key string")).collect()}
    assert got == {1: (1, 6), 2: (3, 6), 3: (2, 7), 4: (1, 8), 5: (1, 2), 6: (4, 7), 10: (4, 9)}


def test_random_row(texts):
    assert corpus.random_row(texts, "virtues").first()["global_id"] == 9 and corpus.random_row(texts).count() == 1


def test_references(spark):
    aliases = corpus.citation_aliases(corpus.collection_dimension(spark))
    asked = spark.createDataFrame([("Sahih Muslim #375a",), ("muslim 272, 273",), ("al-Bukhari 1",), ("Nawawi40 #3",), ("Unknown #1",), ("bukhari",)], "reference string")
    assert {tuple(r) for r in corpus.parse_references(asked, aliases).collect()} == {("Sahih Muslim #375a", "muslim", "375a"), ("muslim 272, 273", "muslim", "272, 273"), ("al-Bukhari 1", "bukhari", "1"), ("Nawawi40 #3", "forty", "3")}


def test_seeds(spark, source):
    patterns = spark.createDataFrame([("prayer", "%PRAYER%"), ("fast", "%fasting%")], "query string, pattern string")
    got = {(r["query"], r["collection"], r["number"]) for r in corpus.seed_relevance(source, patterns).collect()}
    assert got == {("prayer", "muslim", "375 a"), ("prayer", "muslim", "375 b"), ("fast", "muslim", "402b")}


def test_bm25_formula(texts, engine):
    got = {r["corpus_idx"]: r["score"] for r in bm25.scores(engine.keyword, engine.queries("prayer prayer intentions")).collect()}
    import re

    docs = {r["corpus_idx"]: [t for t in re.findall("[a-z0-9']+", f"{r['narrator']} {r['text']}".lower()) if len(t) > 1] for r in texts.collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in {t for d in docs.values() for t in d}}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    want = {i: sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ["prayer", "prayer", "intentions"]) for i, d in docs.items()}
    assert got == pytest.approx({i: round(s, 6) for i, s in want.items() if s > 0}, abs=1e-6)


def test_keyword_tiers_and_filter(engine):
    rows = engine.keyword_search("prayer").orderBy("rank").collect()
    assert [r["collection"] for r in rows] == ["muslim"] * 3 + ["virtues"] and rows[0]["total"] == 4 and [r["grade_tier"] for r in rows[:3]] == [0, 2, 4]
    assert [r["collection"] for r in engine.keyword_search("prayer", ["virtues"]).collect()] == ["virtues"]


def test_terms(engine):
    found = engine.term_search("qunut salat").orderBy("rank").collect()
    assert [(r["corpus_idx"], r["match_logic"], r["total"]) for r in found] == [(3, "and", 1)]
    assert set(found[0]["matched_words"]) == {"قنوت", "صلاة"}
    either = engine.term_search("ramazan qunut").orderBy("rank").collect()
    assert {r["corpus_idx"] for r in either} == {3, 4, 5} and either[0]["match_logic"] == "and_fallback_to_or"
    assert engine.term_search("zzz").collect() == []


def test_term_scope(engine):
    """The intersection holds over the whole corpus but not inside the collection: the flag and the rows disagree, as defined."""
    queries = engine.queries("azan")
    hits = term.hits(engine.terms, queries)
    assert term.logic(hits, queries, engine.corpus, ["muslim"]).first()["match_logic"] is None
    assert engine.term_search("azan", ["muslim"]).collect() == [] and term.logic(hits, queries).first()["match_logic"] == "and"


def test_dense(spark, engine):
    rows = engine.semantic_search("abc").collect()
    table = dense.with_content(engine.embeddings, engine.corpus)
    assert table.count() == 6  # the row without text has no say
    brute = {r["corpus_idx"]: (r["embedding"][0] + 3 * r["embedding"][1]) / math.sqrt(10) for r in table.collect()}
    top = dense.top(table, engine.vectors(engine.queries("abc")), 3).orderBy("rank").collect()
    assert [r["corpus_idx"] for r in top] == sorted(brute, key=lambda i: (-round(brute[i], 6), i))[:3]
    assert len(rows) == 6 and rows[0]["tier"] <= rows[-1]["tier"]
    with pytest.raises(search.SearchError) as e:
        search.Engine(engine.corpus, engine.keyword, engine.terms).semantic_search("x")
    assert e.value.kind == "unavailable"


def legs(spark, rows):
    return spark.createDataFrame(rows, "query_id long, corpus_idx long, score double, rank int")


def test_union_and_norms(spark):
    a, b = legs(spark, [(0, 1, 5.0, 1), (0, 2, 5.0, 2)]), legs(spark, [(0, 2, 10.0, 1), (0, 3, 5.0, 2), (0, 4, 0.0, 3)])
    got = {r["corpus_idx"]: r for r in fusion.union(a, b, None).collect()}
    assert [got[i]["place"] for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert got[1]["bm25_norm"] == got[2]["bm25_norm"] == 1.0 and got[3]["semantic_norm"] == 0.5 and got[4]["semantic_norm"] == 0.0
    assert got[2]["sources"] == ["bm25", "semantic"] and got[1]["semantic"] == 0.0


def test_reciprocal_rank(spark):
    rows = [(0, 0, 1, 5.0, 1), (0, 0, 2, 4.0, 2), (0, 1, 2, 9.0, 1), (0, 1, 3, 8.0, 2)]
    pools = fusion.union(spark.createDataFrame(rows, "query_id long, variant_id long, corpus_idx long, score double, rank int"), None, None, ("query_id", "variant_id"))
    got = fusion.reciprocal_rank(pools).orderBy("place").collect()
    assert [r["corpus_idx"] for r in got] == [2, 1, 3] and got[0]["rrf"] == round(1 / 62 + 1 / 61, 9) and got[0]["bm25"] == 9.0


def test_split_and_pages(spark):
    pool = fusion.union(legs(spark, [(0, i, 1.0 - i / 20, i + 1) for i in range(20)]), None, None).withColumn("score", F.col("bm25"))
    rows = fusion.split(pool, 5, 0.5).persist()
    assert rows.where("bucket = 'strong'").count() == 5 and rows.count() == 20
    assert [r["corpus_idx"] for r in fusion.page(rows, 2, 4).orderBy("at").collect()] == [4]
    assert [r["corpus_idx"] for r in fusion.page(rows, 2, 4, weak=True).orderBy("at").collect()] == [4, 5, 6, 7]
    assert fusion.split(pool, 50).where("bucket = 'strong'").count() == 20


@pytest.mark.parametrize("most", [1, 7, 25, 26])
def test_dense_in_blocks(spark, monkeypatch, most):
    """More query vectors than a block takes give what one block gives."""
    rows = [(i, [math.cos(i * 0.37), math.sin(i * 0.37)]) for i in range(60)]
    table = spark.createDataFrame(rows, "corpus_idx long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v) for i, v in rows[:25]], "query_id long, query array<double>")
    plain = sorted(map(tuple, dense.top(table, asked, 4).collect()))
    monkeypatch.setattr(dense, "MOST_QUERIES", most)
    assert len(plain) == 100 and sorted(map(tuple, dense.top(table, asked, 4).collect())) == plain
    assert dense.top(table, asked.limit(0), 4).count() == 0


def test_modes():
    assert fusion.mode_weights("term") == (0.2, 0.4, 1.0)
    with pytest.raises(ValueError):
        fusion.mode_weights("conept")


def overlap():
    return lambda query, docs: [0.9 if query.split()[0] in d.lower() else 0.1 for d in docs]


def broken():
    def score(query, docs):
        raise RuntimeError("no model")

    return score


def strange():
    def score(query, docs):
        raise KeyError("x")

    return score


def test_rerank(engine):
    rows, how = engine.search("prayer", "keyword", reranker=rerank.Reranker("overlap", overlap))
    got = rows.collect()
    assert how == {"mode": "keyword", "reranker": "overlap", "reranker_status": "ok", "reranker_active": True, "threshold": 0.5}
    assert {r["bucket"] for r in got if "prayer" in r["snippet"].lower()} == {"strong"} and any(r["bucket"] == "weak" for r in got)
    rows, how = engine.search("prayer", "keyword", reranker=rerank.Reranker("broken", broken))
    assert how["reranker_status"] == "fell_back: RuntimeError" and how["threshold"] is None and not how["reranker_active"]
    assert rows.count() == len(got)
    with pytest.raises(Exception, match="KeyError"):
        engine.search("prayer", "keyword", reranker=rerank.Reranker("strange", strange))
    _, how = engine.search("prayer", "keyword")
    assert how["reranker_status"] == "disabled"


def test_configured(monkeypatch):
    rerank.register(rerank.Reranker("overlap", overlap))
    monkeypatch.setenv("RERANKER_NAME", "overlap")
    monkeypatch.setenv("RERANKER_THRESHOLD", "0.25")
    assert rerank.configured().threshold == 0.25
    monkeypatch.setenv("RERANKER_DISABLED", "1")
    assert rerank.configured() is None
    monkeypatch.setenv("RERANKER_DISABLED", "0")
    monkeypatch.setenv("RERANKER_NAME", "none such")
    with pytest.raises(ValueError):
        rerank.configured()


def test_search_guards(engine):
    with pytest.raises(search.SearchError) as e:
        engine.search("x", collections=["nowhere"])
    assert e.value.kind == "unknown_collection"
    with pytest.raises(ValueError):
        engine.search("x", "conept")
    assert engine.pool(engine.queries("", "   ")).count() == 0 and engine.checked(0, None) == 1 and engine.checked(10**9, None) == 50_000
    rows, _ = engine.search("qunut", "term", ["muslim"])
    assert {r["collection"] for r in rows.collect()} == {"muslim"}


def test_natural(engine):
    rows, how = engine.natural("what about prayer", lambda q: ("keyword", ["prayer", "", "fasting"]))
    assert how["variants"] == ["prayer", "fasting"] and how["fallback"] is None and rows.count() > 0
    assert engine.natural("prayer", None)[1]["fallback"] == "llm_unavailable"
    assert engine.natural("prayer", lambda q: None)[1]["fallback"] == "router_failed"
    assert engine.natural("prayer", lambda q: 1 / 0)[1]["fallback"] == "router_failed"
    assert engine.natural("prayer", lambda q: ("reference", ["prayer"]))[1]["mode"] == "concept"


def test_chips_and_filters(spark, engine):
    scored = fusion.weighted(engine.pool(engine.queries("qunut")), "term")
    strong, weak = fusion.split(scored, 10, 0.9), fusion.split(scored, 10, 99.0)
    assert {r["word"] for r in fusion.chip_words(strong).collect()} <= {r["word"] for r in fusion.chip_words(weak).collect()} == {"قنوت"}
    assert fusion.filtered(strong, None, ["قنوت"]).count() == 2 and fusion.filtered(strong, [], []).count() == strong.count()


def test_facet_order(spark):
    slugs = [("zed", "Alpha"), ("muslim", "Sahih Muslim"), ("adab", "Beta"), ("bukhari", "Sahih al-Bukhari"), ("ibnmajah", "Sunan")]
    got = fusion.facet_order(spark.createDataFrame(slugs, "slug string, english_title string")).orderBy("position").collect()
    assert [r["slug"] for r in got] == ["bukhari", "muslim", "ibnmajah", "zed", "adab"]


def test_render(spark, texts, engine):
    rows, _ = engine.search("prayer", "keyword")
    assert any(r["line"].startswith("- Sahih Muslim #375 a — Hasan") for r in render.hit_lines(rows).collect())
    dim = corpus.collection_dimension(spark)
    line = render.record_lines(corpus.record(texts.where("global_id = 6"), dim, "example.org")).first()["line"]
    assert "Sahih Muslim #375 a — Hasan" in line and line.endswith("Reference: example.org/muslim:375a")
    assert render.collection_lines(corpus.list_collections(texts, dim)).orderBy("slug").first()["line"] == "- bukhari: Sahih al-Bukhari — 2 texts"


def test_evaluation(spark):
    ranked = spark.createDataFrame([(0, i, i) for i in range(1, 13)] + [(1, 99, 1)], "query_id long, doc long, rank int")
    relevant = spark.createDataFrame([(0, 1), (0, 3), (0, 3), (0, 11), (0, 50), (1, 5), (2, 1)], "query_id long, doc long")
    got = {r["query_id"]: r for r in evaluate.per_query(ranked, relevant, ["doc"]).collect()}
    ideal = sum(1 / math.log2(i + 2) for i in range(4))
    assert got[0]["precision"] == 0.2 and got[0]["recall"] == 0.75 and got[0]["ndcg"] == round((1 + 1 / math.log2(4)) / ideal, 4)
    assert got[1]["precision"] == got[1]["ndcg"] == 0 and got[2]["n_retrieved"] == 0
    macro = evaluate.macro(evaluate.per_query(ranked, relevant, ["doc"])).first()
    assert macro["n_queries"] == 3 and macro["recall"] == 0.25


def test_sweep(spark):
    rows = [(0, 0.9, 1), (0, 0.35, 0), (0, 0.3, 1), (1, 0.5, 0), (1, 0.05, 1), (1, 1.0, 1), (1, -3.0, 1)]
    curve = {r["threshold"]: r for r in evaluate.sweep(spark.createDataFrame(rows, "query_id long, score double, relevant int"), 0.05).collect()}
    assert len(curve) == 21
    for t, r in curve.items():
        p_, r_ = [], []
        for q in (0, 1):
            own = [(s, k) for i, s, k in rows if i == q]
            shown = [k for s, k in own if s >= t - 1e-9]
            p_.append(sum(shown) / len(shown) if shown else 0)
            r_.append(sum(shown) / sum(k for _, k in own))
        assert r["macro_precision"] == pytest.approx(sum(p_) / 2, abs=1e-4) and r["macro_recall"] == pytest.approx(sum(r_) / 2, abs=1e-4)
