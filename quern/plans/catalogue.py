"""Every operator as a query over the tables, beside the SQL that gives the same rows."""

from __future__ import annotations

import asyncio

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import render
from quern.functions import text as T
from quern.operators import blockmax, bm25, corpus, dense, evaluate, fusion, latency, nearest, patterns, rerank, search, term
from quern.operators.sizes import settled
from quern.plans.binding import CORPUS_SQL, SOURCE_SQL, arabic_word, dimension, embeddings, source, source_dimension, table
from quern.plans.binding import corpus as bound
from quern.sources import tables
from quern.sources.dump_source import DumpSource
from quern.sources.kept import kept, local_scratch, scratch
from quern.streaming.refresh import chained
from quern.streaming.segments import Store

KEYWORD = [(0, "licensed under the public license"), (1, "was with that the the"), (2, "password token secret")]
TERMS = [(0, "thesat shedon"), (1, "al thonin"), (2, "ereder onsh thin"), (3, "zzzqqq"), (4, "e")]
#: Every vector of an id that this divides is a query by example, of the id divided by it.
EXAMPLE_STEP = 20
KEYS = [(1, "src0", "12"), (2, "src1", "7 A"), (3, "src2", "33"), (4, "src3", "2"), (5, "src0", "999999"), (6, "nowhere", "1"), (7, "src5", " 101b "), (8, "src4", "5")]
PICKED = ["src1", "src2", "src3"]


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _keyword(spark):
    return _values(spark, KEYWORD, "query_id long, text string")


def _terms(spark):
    return _values(spark, TERMS, "query_id long, text string")


def _vectors(spark, d):
    own = F.floor(F.col("corpus_idx") / EXAMPLE_STEP).alias("query_id")
    return embeddings(spark, d).where(F.col("corpus_idx") % EXAMPLE_STEP == 0).select(own, F.transform("embedding", lambda x: x.cast("double")).alias("query"))


_BUILT: dict[tuple, object] = {}


def _once(spark, d, name, build):
    """An index is built once a session and table set, written to the shared folder and read from there."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        index, path = build(), scratch(spark, name)
        index.write(path)
        _BUILT[key] = type(index).read(spark, path)
    return _BUILT[key]


def _bm_index(spark, d):
    return _once(spark, d, "bm25", lambda: bm25.build(bound(spark, d)))


def _passages(spark, d):
    """Every benchmark passage, whole, as a query."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _blocks(spark, d):
    return _once(spark, d, "blocks", lambda: blockmax.build(_bm_index(spark, d)))


def _nearest(spark, d):
    return _once(spark, d, "nearest", lambda: nearest.build(embeddings(spark, d)))


def _refreshed(spark, d):
    """A store that took documents in two drops of files, the first with old texts and without a third of the rows, and one of them twice."""
    drops, store = scratch(spark, "drops"), Store(spark, scratch(spark, "store"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("corpus_idx"), "text", "source")
    old = docs.where("corpus_idx % 3 <> 0").withColumn("text", F.when(F.col("corpus_idx") % 5 == 0, F.concat(F.lit("old words "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    said = []
    for rows in (old, docs, docs):
        rows.write.mode("append").parquet(drops)
        said += chained(spark, drops, docs.schema, f"{store.path}/checkpoint", store)
    return store, said


def _dumped(spark, d):
    """Customers written as a dump, in small splits and with every escape in a text, and some of their columns read back."""
    spark.dataSource.register(DumpSource)
    path, rows = local_scratch(spark, "dump"), table(spark, d, "customer")
    odd = F.concat("c_name", F.lit(" 'q' \"d\" \\ \n\t\r, ) (;"))
    rows.select("c_custkey", odd.alias("note"), "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"), "c_nationkey").write.format("sqldump").option("table", "customer").mode("append").save(path)
    read = spark.read.format("sqldump").option("table", "customer").option("columns", "c_custkey,note,c_acctbal,segment,c_nationkey").option("splitBytes", 20_000)
    return read.schema("note string, c_custkey long, segment string, c_acctbal double").load(path)


def _written_table(spark, d):
    """The bound corpus written as a checked table and read back."""
    path = scratch(spark, "table")
    tables.write_table(bound(spark, d), path, "corpus_idx")
    return spark.read.parquet(path).select("corpus_idx", "collection", "book", "id_in_book", "number", "grade_tier")


def _written_vectors(spark, d):
    """Texts encoded by their letters, written with the corpus's fingerprint and read back under it."""
    rows, path = bound(spark, d), scratch(spark, "vectors")
    mark = tables.fingerprint(rows, F.coalesce("text", F.lit("")))

    def encoder():
        return lambda texts: np.array(_letters(texts))

    tables.write_embeddings(dense.build(rows, encoder), path, "letters", mark)
    read = tables.read_embeddings(spark, path, tables.fingerprint(rows.repartition("corpus_idx"), F.coalesce("text", F.lit(""))))
    return read.select("corpus_idx", *(F.round(F.col("embedding")[i].cast("double"), 4).alias(c) for c, i in (("e", 4), ("n", 13), ("z", 25))))


def _query_set(spark, d):
    """Benchmark passages as a query set's JSON, written as a report is and read back."""
    path = scratch(spark, "query-set")
    relevant = F.array(F.struct(F.concat(F.lit("c"), F.col("item_id") % 3).alias("collection"), F.col("item_id").cast("string").alias("hadith_number")))
    one = F.struct("item_id", F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "keyword").alias("mode_hint"), relevant.alias("relevant"))
    tables.write_report(table(spark, d, "benchmark").agg(F.sort_array(F.collect_list(one)).alias("queries")), path)
    queries, known = tables.read_query_set(spark, path)
    return queries.join(known, "query_id").select("text", "mode", "collection", "number")


def _single(spark, query, text):
    """One query as a local table: no task and no Python worker reads it."""
    return spark.createDataFrame(pa.table({"query_id": pa.array([query], pa.int64()), "text": pa.array([text], pa.string())}))


def _latency(spark, d):
    """Keyword search of each benchmark passage by itself, timed; the time itself differs from run to run."""
    index, asked = _bm_index(spark, d), _passages(spark, d).collect()  # a driver's loop, as a user's single queries are
    one = lambda r: lambda: bm25.first(bm25.scores(index, _single(spark, r["query_id"], r["text"])), 10)
    took = latency.measured(spark, [(r["query_id"], one(r)) for r in asked])
    measured = _evaluated(spark, d)[0].join(took.select("query_id", "latency_ms"), "query_id", "left")
    return evaluate.macro(measured).crossJoin(took.agg(F.count(F.lit(1)).alias("timed"), F.sum("rows").alias("rows"))).select("n_queries", "precision", "ndcg", "recall", "timed", "rows", (F.col("mean_latency_ms") > 0).alias("took_time"))


def _bm(spark, d, queries=None):
    return bm25.scores(_bm_index(spark, d), queries if queries is not None else _keyword(spark))


def _term_index(spark, d):
    return _once(spark, d, "term", lambda: term.build(bound(spark, d), T.latin_words, "text"))


def _hits(spark, d):
    return term.hits(_term_index(spark, d), _terms(spark))


def _term_scores(spark, d):
    return term.scores(_hits(spark, d))


def _dense(spark, d, k=100):
    """The queries grow with the rows: they meet an index of the rows with content, and what is found is kept."""
    index = _once(spark, d, "nearest-filled", lambda: nearest.build(dense.with_content(embeddings(spark, d), bound(spark, d))))
    return kept(nearest.top(index, _vectors(spark, d), k), "dense")


def _pool(spark, d, k=50):
    """Three legs of unlike queries under the same ids: a union with texts that one, two or three legs find."""
    return kept(fusion.union(bm25.top(_bm(spark, d), k), _dense(spark, d, k), bm25.top(_term_scores(spark, d), k)), "pool")


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


def _flat(pool):
    return pool.select(*(_joined(c) if c in ("sources", "matched_words") else F.round(c, 6).alias(c) if c in dict(pool.dtypes) and dict(pool.dtypes)[c] == "double" else c for c in pool.columns))


def _split(spark, d, mode="concept", limit=10, threshold=0.5):
    return fusion.split(fusion.weighted(_pool(spark, d), mode), limit, threshold)


def _eval_queries(spark, d):
    """Each benchmark passage, whole, and the documents that hold any five of its words in a row."""
    words = _passages(spark, d).select("query_id", T.tokens(F.col("text")).alias("w"))
    grams = words.select("query_id", F.explode(_runs_of_five("w")).alias("gram")).distinct()
    toks = table(spark, d, "documents").select(F.col("doc_id").alias("corpus_idx"), T.tokens(F.col("text")).alias("t"))
    # a document's runs meet the passages' by hash, without their texts; equal hashes are then compared word by word
    held = toks.select("corpus_idx", "t", F.posexplode(F.transform(_runs_of_five("t"), lambda r: F.xxhash64(r))).alias("at", "hash"))
    hashed = grams.withColumn("hash", F.xxhash64("gram"))
    found = held.join(settled(hashed, MOST_RUNS), "hash").where(F.slice("t", F.col("at") + 1, F.lit(5)) == F.col("gram"))
    return _passages(spark, d), found.select("query_id", "corpus_idx").distinct()


#: Runs of words that are broadcast at most; more are joined by a shuffle.
MOST_RUNS = 200_000


def _runs_of_five(column: str):
    """All runs of five words of an array of them."""
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(column) - 4, F.lit(1))), lambda i: F.slice(column, i, F.lit(5)))
    return F.filter(whole, lambda r: F.size(r) == 5)


def _evaluated(spark, d):
    queries, relevant = _eval_queries(spark, d)
    ranked, relevant = kept(bm25.best(_bm_index(spark, d), queries, 100), "ranked"), kept(relevant, "relevant")  # both are read more than once
    return evaluate.per_query(ranked, relevant, ["corpus_idx"]), ranked, relevant


def _sweep(spark, d, places=4):
    _, ranked, relevant = _evaluated(spark, d)
    norm = fusion.union(ranked, None, None).select("query_id", "corpus_idx", F.round("bm25_norm", 6).alias("score"))
    return evaluate.sweep(evaluate.flagged(norm, relevant, ["corpus_idx"]), 0.05, places)


def _turns(spark, d):
    talk = table(spark, d, "conversations")
    return talk.select("conv_id", "turn", F.concat(F.lit(" <p>"), "role", F.lit(":\n<p>"), F.coalesce("text", F.lit("")), F.lit("\n\n\n\nend ")).alias("text"))


def _marked(spark, d):
    """Markup made of the tables: a chain of two names and a section mark."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.format_string('[prematn]before [narrator id="%d" role="first" tooltip="T %s"] %s [/narrator] and [narrator id="%d" role="chain" tooltip=""]second\nname[/narrator] after', "c_custkey", "c_name", "c_name", F.col("c_custkey") + 1).alias("m"))


GRADES = ["", "Sahih", "Sahīh", "Hasan Sahih", "Da'if", "Da’if", "Sahih (Darussalam)]", "[Its isnad is Sahih]", "Maudu", "Fabricated", "xyzqq", '[{"graded_by":"a","grade":"Sahīh"}]', "[{\"grade\":\"Muttafaqun 'alayh\"}]", '[{"graded_by":"a"}]', "[{broken sahih", "weak"]


def _grades(spark, d):
    """Every labelled document with a grade in one of the forms that grades have."""
    forms = F.array(*(F.lit(g) for g in GRADES))
    raw = F.element_at(forms, ((F.col("doc_id") * 7 + F.coalesce("quality", F.lit(0)) * 3 + F.coalesce("toxic", F.lit(0))) % len(GRADES) + 1).cast("int"))
    return table(spark, d, "labels").select("doc_id", raw.alias("raw")).select("doc_id", "raw", T.grade_class(F.col("raw")).alias("cls")).withColumn("tier", T.grade_tier(F.col("cls")))


def _cited(spark, d):
    """A citation of every document, in one of four forms."""
    i, name = F.col("doc_id"), F.col("source")
    form = F.when(i % 4 == 0, F.concat(F.upper(name), F.lit(" #"), i)).when(i % 4 == 1, F.concat(F.lit(" Sahih "), name, F.lit(" "), i, F.lit(", "), i + 1)).when(i % 4 == 2, F.concat(F.lit("nothing #"), i)).otherwise(F.concat(name, F.lit("#"), i, F.lit("b ")))
    return table(spark, d, "documents").select(form.alias("reference")).distinct()


def _any_of(spark, d):
    """Every three words of each benchmark passage as a pattern, over all documents."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.split("text", " ").alias("w")).where(F.size("w") >= 3)
    runs = words.select("query", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("i"), "w").select("query", F.concat(F.lit("%"), F.array_join(F.slice("w", F.col("i"), F.lit(3)), "_"), F.lit("%")).alias("pattern"))
    return patterns.any_of(table(spark, d, "documents"), ["doc_id"], "text", runs, fold=True).groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def _variants(spark, d):
    """Three variants of one question: the keyword queries' pools as one."""
    pools = fusion.union(bm25.top(_bm(spark, d), 50), None, bm25.top(_term_scores(spark, d), 50)).where("query_id < 3")
    return fusion.reciprocal_rank(pools.withColumnRenamed("query_id", "variant_id").withColumn("query_id", F.lit(0).cast("long")))


def _reranked(spark, d):
    queries = _keyword(spark)
    pool = fusion.union(bm25.top(_bm(spark, d), 50), None, None)

    def overlap():
        return lambda query, docs: [len({*query.lower().split()} & {*x.lower().split()}) / (1 + len(query.split())) for x in docs]

    scored, _, _, threshold = rerank.scored_pool(pool, bound(spark, d), queries, "keyword", rerank.Reranker("overlap", overlap, 0.4))
    return fusion.split(scored.withColumn("score", F.round("score", 6)), 10, threshold).select("query_id", "corpus_idx", "rank", "score", "bucket")


def _listwise(spark, d):
    """Pools of keyword rows ranked by a scorer that judges a text by the whole list: the share of its texts that hold fewer of the query's words."""
    queries = _keyword(spark)

    def share():
        def scores(query, docs):
            held = [len({*query.lower().split()} & {*x.lower().split()}) for x in docs]
            return [sum(o < h for o in held) / len(docs) for h in held]

        return scores

    pool = fusion.union(bm25.top(_bm(spark, d), 50), None, None)
    scored, _, _, threshold = rerank.scored_pool(pool, bound(spark, d), queries, "keyword", rerank.Reranker("share", share, 0.5, window=50))
    return fusion.split(scored.withColumn("score", F.round("score", 6)), 10, threshold).select("query_id", "corpus_idx", "rank", "score", "bucket")


QUESTIONS = [(0, "what is licensed"), (1, "password token secret"), (2, "was with that the the")]


def _natural_many(spark, d):
    """Three questions at once: one that a router turns into two variants, one that it fails on, one that it is too slow for."""

    def router():
        async def answer(question):
            if "password" in question:
                raise RuntimeError("no answer")
            if "with" in question:
                await asyncio.sleep(60)
            return "reference", [VARIANTS[0], " ", VARIANTS[1]]

        return answer

    engine = search.Engine(bound(spark, d), _bm_index(spark, d), _term_index(spark, d))
    return engine.respond_natural(_values(spark, QUESTIONS, "query_id long, text string"), router, limit=5, deadline=0.5)


def _natural(spark, d):
    c = bound(spark, d)
    engine = search.Engine(c, _bm_index(spark, d), _term_index(spark, d))
    rows, _ = engine.natural("what is licensed", lambda q: ("reference", [VARIANTS[0], " ", VARIANTS[1]]), limit=5)
    return rows.select("bucket", "rank", "corpus_idx", "score")


def _built(spark, d):
    return corpus.build(source(spark, d), source_dimension(spark, d))


def _arabic_index(spark, d):
    return _once(spark, d, "arabic", lambda: term.build(_built(spark, d)))


ARABIC_TERMS = [(0, "salat"), (1, "qunut ramazan"), (2, "azan"), (3, "zzz")]


def _arabic_hits(spark, d):
    return term.hits(_arabic_index(spark, d), _values(spark, ARABIC_TERMS, "query_id long, text string"))


def _letters(texts):
    """Texts by how often each letter a-z stands in them, on the first axes of the vectors at hand."""
    return [[float(t.count(chr(97 + i))) for i in range(26)] + [0.0] * 38 for t in texts]


def _engine(spark, d, *legs):
    """The three legs, or those that are named, over the bound corpus; a text is encoded by its letters."""
    legs = legs or ("keyword", "term", "dense")
    keyword, terms = _bm_index(spark, d) if "keyword" in legs else None, _term_index(spark, d) if "term" in legs else None
    return search.Engine(bound(spark, d), keyword, terms, embeddings(spark, d) if "dense" in legs else None, _letters, dimension(spark, d))


def _counted(summary):
    """A summary with its words as text, and without the fields that say nothing here."""
    words = F.array_join(F.transform("matched_words", lambda w: F.concat_ws(":", w["word"], w["count"])), "|")
    return summary.withColumn("matched_words", words) if "matched_words" in summary.columns else summary


def _summary(spark, d):
    """The summary of the pooled rows, for five queries of which one finds nothing."""
    queries = _values(spark, [*TERMS, (5, "nothing at all")], "query_id long, text string")
    how = {"reranker": "overlap", "reranker_status": "ok", "reranker_active": True, "threshold": 0.5}
    said = term.logic(_hits(spark, d), queries)
    return _counted(search.ranked_summary(queries, _split(spark, d, limit=10), "term", 10, how, None, said)).drop("collections")


def _plain_rows(response):
    return response.rows.select(*(F.array_join(c, "|").alias(c) if c == "matched_words" else F.round(c, 6).alias(c) if c == "similarity" else c for c in response.rows.columns if c != "collection"))


QUERIES = {
    "corpus_build": lambda s, d: _built(s, d).select("corpus_idx", "collection", "id_in_book", "global_id", "chapter_id", "narrator", F.sha2("text", 256).alias("text_sha256"), "number", "book", "urn", "grade", "grade_tier", "tier"),
    "chapters": lambda s, d: corpus.chapters(source(s, d)),
    "chapters_of_collection": lambda s, d: corpus.books(corpus.chapters(source(s, d)), "src2"),
    "seed_relevance": lambda s, d: corpus.seed_relevance(source(s, d), _values(s, [("a", "%EN 1%"), ("a", "%باب%"), ("b", "%de%")], "query string, pattern string")),
    "table_report": lambda s, d: tables.load_report(bound(s, d)),
    "record_with_chain": lambda s, d: corpus.record(_built(s, d), source_dimension(s, d), "site").select("corpus_idx", "english_title", "narrator", F.size("chain").alias("n_chain"), F.col("chain")[0]["inline_name"].alias("first_name"), T.without_markup(F.col("arabic")).alias("arabic"), "reference"),
    "get_record": lambda s, d: corpus.get(_built(s, d), source_dimension(s, d), "src1", "1").select("corpus_idx", "english_title", "number", "reference"),
    "arabic_word_frequency": lambda s, d: _arabic_index(s, d).words,
    "arabic_term_search": lambda s, d: bm25.top(term.scores(_arabic_hits(s, d)), 50).select("query_id", "rank", "corpus_idx", "score"),
    "response_summary": _summary,
    "plain_keyword_rows": lambda s, d: _plain_rows(_engine(s, d, "keyword").respond_keyword(_keyword(s), None, 10, False)),
    "plain_keyword_summary": lambda s, d: _engine(s, d, "keyword").respond_keyword(_keyword(s), PICKED, 10, False).summary.select("query_id", "query", "total", "limit", F.array_join("collections", ",").alias("collections")),
    "plain_term_rows": lambda s, d: _plain_rows(_engine(s, d, "term").respond_term(_terms(s), None, 20, False)),
    "plain_term_summary": lambda s, d: _counted(_engine(s, d, "term").respond_term(_terms(s), None, 20, False).summary).select("query_id", "total", "matched_words", "match_logic"),
    "plain_semantic_rows": lambda s, d: _plain_rows(_engine(s, d, "dense").respond_semantic(_values(s, [(0, "any")], "query_id long, text string"), None, 10, False)),
    "ranked_response": lambda s, d: _engine(s, d).respond(_values(s, [KEYWORD[0]], "query_id long, text string"), "keyword", None, 10, 50).rows.select("query_id", "bucket", "rank", "corpus_idx", "score", "title", "snippet"),
    "best_threshold_unrounded": lambda s, d: evaluate.reported(evaluate.best_threshold(_sweep(s, d, None))),
    "bm25_topk": lambda s, d: bm25.top(_bm(s, d), 10).select("query_id", "rank", "corpus_idx", "score"),
    "table_round_trip": _written_table,
    "vectors_round_trip": _written_vectors,
    "query_set_round_trip": _query_set,
    "eval_latency": _latency,
    "collection_lines": lambda s, d: render.collection_lines(corpus.list_collections(bound(s, d), dimension(s, d))),
    "chapter_lines": lambda s, d: render.chapter_lines(corpus.chapters(source(s, d))).select("collection", "bookNumber", "babID", "line"),
    "keyword_summary_lines": lambda s, d: (lambda r: render.summary_lines(r.summary, r.rows, "keyword"))(_engine(s, d, "keyword").respond_keyword(_values(s, [*KEYWORD, (3, "zzzqqq")], "query_id long, text string"), PICKED, 10, False)),
    "record_lines": lambda s, d: render.record_lines(corpus.record(_built(s, d), source_dimension(s, d), "site")).select("corpus_idx", "line"),
    "blockmax_topk": lambda s, d: blockmax.top(_blocks(s, d), _passages(s, d), 10).select("query_id", "rank", "corpus_idx", "score"),
    "dense_exact_topk": lambda s, d: nearest.top(_nearest(s, d), _vectors(s, d), 20).select("query_id", "rank", "corpus_idx", "score"),
    "refreshed_topk": lambda s, d: bm25.top(bm25.scores(_refreshed(s, d)[0].index(), _keyword(s)), 10).select("query_id", "rank", "corpus_idx", "score"),
    "refresh_report": lambda s, d: _values(s, [(i, r["added"], r["replaced"], r["removed"], r["unchanged"]) for i, r in enumerate(_refreshed(s, d)[1])], "batch long, added long, replaced long, removed long, unchanged long"),
    "dump_round_trip": _dumped,
    "bm25_collections": lambda s, d: bm25.top(_bm(s, d), 10, bound(s, d), PICKED).select("query_id", "rank", "corpus_idx", "score"),
    "bm25_term_statistics": lambda s, d: _bm_index(s, d).terms.select("term", "df", F.round("idf", 6).alias("idf")),
    "bm25_lengths": lambda s, d: _bm_index(s, d).lengths,
    "tiered_keyword": lambda s, d: bm25.tiered(_bm(s, d), bound(s, d), 20).select("query_id", "rank", "corpus_idx", "score", "total"),
    "list_collections": lambda s, d: corpus.list_collections(bound(s, d), dimension(s, d)),
    "list_books": lambda s, d: corpus.books(corpus.chapters(source(s, d)), "src0"),
    "lookup_ladder": lambda s, d: corpus.lookup(bound(s, d), _values(s, KEYS, "key_id long, collection string, key string")).select("key_id", "rule", "corpus_idx"),
    "random_row": lambda s, d: corpus.random_row(bound(s, d), seed=7).select("corpus_idx", "collection"),
    "random_row_of_collection": lambda s, d: corpus.random_row(bound(s, d), "src3", 11).select("corpus_idx", "collection"),
    "drawn_rows": lambda s, d: corpus.drawn(bound(s, d), 3, 5, "collection").select("corpus_idx", "collection"),
    "record": lambda s, d: corpus.record(_built(s, d), source_dimension(s, d)).select("corpus_idx", "english_title", "id_in_book", "narrator", F.size("chain").alias("n_chain"), "reference"),
    "parse_references": lambda s, d: corpus.parse_references(_cited(s, d), corpus.citation_aliases(dimension(s, d))),
    "tokenise": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens")),
    "snippet": lambda s, d: table(s, d, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("The ")).alias("snippet"), T.head(F.col("text"), 140).alias("head")),
    "grade_classes": _grades,
    "split_narrator": lambda s, d: _turns(s, d).select("conv_id", "turn", T.split_narrator(F.col("text")).alias("p")).select("conv_id", "turn", "p.narrator", "p.body"),
    "clean_html": lambda s, d: table(s, d, "pages").select("page_id", T.without_tags(F.col("html")).alias("text"), F.length(T.clean(F.col("html"))).cast("long").alias("n")),
    "narrator_chain": lambda s, d: _marked(s, d).select("c_custkey", F.explode(T.narrators(F.col("m"))).alias("n")).select("c_custkey", "n.position", "n.id", "n.role", "n.tooltip", "n.inline_name"),
    "strip_markup": lambda s, d: _marked(s, d).select("c_custkey", T.without_markup(F.col("m")).alias("text")),
    "embedding_text": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.embedding_text(F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(""), F.col("text")).alias("text")),
    "eval_keys": lambda s, d: bound(s, d).select("corpus_idx", T.eval_key(F.col("number")).alias("key"), T.citation(F.col("number"), F.col("id_in_book")).alias("cite")),
    "dense_topk": lambda s, d: _dense(s, d, 20).select("query_id", "rank", "corpus_idx", "score"),
    "dense_scores": lambda s, d: dense.scores(embeddings(s, d), _vectors(s, d)),
    "dense_tiered": lambda s, d: dense.oversampled(_dense(s, d, dense.pool_size(10)), bound(s, d), 10).select("query_id", "rank", "corpus_idx", "score"),
    "skeletons": lambda s, d: _term_index(s, d).words.select("word", F.array_join(F.array_sort(T.index_skeletons(F.col("word"))), "|").alias("skeletons")),
    "term_document_frequency": lambda s, d: _term_index(s, d).words,
    "term_search": lambda s, d: bm25.top(_term_scores(s, d), 20).select("query_id", "rank", "corpus_idx", "score", _joined("matched_words")),
    "term_collections": lambda s, d: bm25.top(_term_scores(s, d), 20, bound(s, d), PICKED).select("query_id", "rank", "corpus_idx", "score"),
    "term_word_counts": lambda s, d: term.word_counts(term.matches(_hits(s, d))),
    "match_logic": lambda s, d: term.logic(_hits(s, d), _terms(s)),
    "match_logic_collections": lambda s, d: term.logic(_hits(s, d), _terms(s), bound(s, d), PICKED),
    "term_tiered": lambda s, d: term.by_row(_hits(s, d), bound(s, d), 20).select("query_id", "rank", "corpus_idx", "total"),
    "union_pool": lambda s, d: _flat(_pool(s, d)),
    **{f"weighted_{m}": (lambda m: lambda s, d: fusion.weighted(_pool(s, d), m).select("query_id", "corpus_idx", "place", "score"))(m) for m in ("concept", "keyword", "term")},
    "strong_weak_split": lambda s, d: _split(s, d).select("query_id", "rank", "corpus_idx", "score", "bucket"),
    "hydrated_rows": lambda s, d: fusion.hydrate(_split(s, d), bound(s, d), _keyword(s), dimension(s, d)).select("query_id", "rank", "bucket", "title", "id_in_book", "number", "grade", "snippet", _joined("matched_words"), F.round("similarity", 6).alias("similarity")),
    "chip_words": lambda s, d: fusion.chip_words(_split(s, d)),
    "chip_words_weak": lambda s, d: fusion.chip_words(_split(s, d, threshold=2.0)),
    "facets": lambda s, d: fusion.facets(_split(s, d).join(bound(s, d).select("corpus_idx", "collection"), "corpus_idx")),
    "facet_order": lambda s, d: fusion.facet_order(corpus.list_collections(bound(s, d), dimension(s, d)).select("slug", "english_title")),
    "merged_order": lambda s, d: fusion.merged_order(_split(s, d).withColumns({"score": F.when(F.col("corpus_idx") % 3 == 0, 0.0).otherwise(F.col("score")), "similarity": F.round("semantic", 6)}).drop("rank")).select("query_id", "bucket", "corpus_idx", "rank"),
    "facet_filter": lambda s, d: fusion.filtered(_split(s, d).join(bound(s, d).select("corpus_idx", "collection"), "corpus_idx"), PICKED, None).select("query_id", "corpus_idx", "collection"),
    "page_2": lambda s, d: fusion.page(_split(s, d), 2, 10, weak=True).select("query_id", "at", "corpus_idx"),
    "rrf_merge": lambda s, d: _variants(s, d).select("corpus_idx", "rrf", F.round("bm25", 6).alias("bm25"), F.round("term", 6).alias("term"), _joined("sources")),
    "reranked": _reranked,
    "natural_search": _natural,
    "natural_many_rows": lambda s, d: _natural_many(s, d).rows.select("query_id", "bucket", "rank", "corpus_idx", "score"),
    "natural_many_summary": lambda s, d: _natural_many(s, d).summary.select("query_id", "query", "mode_hint", F.array_join("variants", "|").alias("variants"), "fallback", "pool_size", "limit", "reranker"),
    "listwise_rank": _listwise,
    "eval_per_query": lambda s, d: _evaluated(s, d)[0],
    "eval_macro": lambda s, d: evaluate.macro(_evaluated(s, d)[0]),
    "threshold_sweep": _sweep,
    "best_threshold": lambda s, d: evaluate.best_threshold(_sweep(s, d)),
    "load_report": lambda s, d: tables.load_report(bound(s, d)),
    "patterns_any_of": _any_of,
    "seed_labels": lambda s, d: patterns.any_of(table(s, d, "documents"), ["doc_id"], "text", _values(s, [("a", "%licensed%"), ("a", "%THE THE%"), ("b", "%password%")], "query string, pattern string"), fold=True).select("query", "doc_id").distinct(),
}

TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9'']+'), lambda t: length(t) >= 2)"


def _sql_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _bm_sql(queries: str) -> str:
    return f"""
kq AS ({queries}),
words AS (SELECT doc_id AS corpus_idx, {TOKENS.format("text")} AS toks FROM documents),
lengths AS (SELECT corpus_idx, CAST(len(toks) AS INTEGER) AS dl FROM words),
posts AS (SELECT term, corpus_idx, count(*) AS tf FROM (SELECT corpus_idx, unnest(toks) AS term FROM words) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
stats AS (SELECT n, avgdl, (SELECT avg(ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)) FROM terms, size) AS mean_idf FROM size),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS term FROM kq) GROUP BY ALL),
raw AS (SELECT query_id, term, times, avgdl, mean_idf, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM qt JOIN terms USING (term), stats),
weight AS (SELECT query_id, term, avgdl, times * CASE WHEN r < 0 THEN 0.25::DOUBLE * mean_idf ELSE r END AS w FROM raw),
bm AS (SELECT query_id, corpus_idx, round(sum(w * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM posts JOIN weight USING (term) JOIN lengths USING (corpus_idx) GROUP BY ALL HAVING score > 0)"""


KEYWORD_SQL = f"SELECT * FROM (VALUES {_sql_values(KEYWORD)}) v(query_id, text)"
_BM = _bm_sql(KEYWORD_SQL)


def _top(rows: str, k: int, more: str = "", where: str = "") -> str:
    return f"SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_idx) AS INTEGER) AS rank, corpus_idx, score{more} FROM {rows} {where}) WHERE rank <= {k}"


_IN = "(" + ", ".join(f"'{c}'" for c in PICKED) + ")"
_PICK = f"SEMI JOIN (SELECT corpus_idx FROM corpus WHERE collection IN {_IN}) USING (corpus_idx)"

_DENSE = f"""
vq AS (SELECT v.query_id, CAST(e.embedding AS DOUBLE[]) AS q FROM (SELECT vec_id // {EXAMPLE_STEP} AS query_id, vec_id FROM embeddings WHERE vec_id % {EXAMPLE_STEP} = 0) v JOIN embeddings e USING (vec_id)),
near_all AS (SELECT query_id, vec_id AS corpus_idx, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, vq),
near AS (SELECT n.* FROM near_all n JOIN documents d ON n.corpus_idx = d.doc_id WHERE trim(coalesce(d.text, '')) <> '')"""


def _skeleton(x: str) -> str:
    for a, b in (("kh", "k"), ("gh", "g"), ("dh", "d"), ("th", "t"), ("sh", "s")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace({x}, '[aeiouwyv]|[^a-z]', '', 'g')"


def _runs(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 or c <> string_split({x}, '')[i - 1]), '')"


def _term_sql(queries: str) -> str:
    return f"""
held AS (SELECT DISTINCT doc_id AS corpus_idx, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents),
df AS (SELECT word, count(*) AS df FROM held GROUP BY word),
fold0 AS (SELECT word, unnest([{_skeleton("lower(word)")}, {_skeleton("lower(replace(replace(word, 'D', 'z'), 'dh', 'z'))")}]) AS s FROM df),
fold AS (SELECT DISTINCT word, {_runs("s")} AS skeleton FROM fold0 WHERE s <> ''),
tq AS (SELECT query_id, unnest(range(len(w))) AS token, unnest(w) AS t FROM (
  SELECT query_id, CASE WHEN len(ws) > 0 THEN ws ELSE [lower(text)] END AS w FROM (
    SELECT query_id, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x NOT IN ('', 'e', 'ul', 'al', 'ush', 'ash', 'an', 'ar', 'as', 'at', 'az', 'ad')) AS ws
    FROM ({queries})))),
ts0 AS (SELECT query_id, token, {_skeleton("t")} AS s FROM tq),
ts AS (SELECT query_id, token, {_runs("s")} AS skeleton FROM ts0 WHERE s <> ''),
hits AS (SELECT DISTINCT query_id, token, corpus_idx, word FROM ts JOIN fold USING (skeleton) JOIN held USING (word)),
per_row AS (SELECT query_id, corpus_idx, count(DISTINCT token) AS n FROM hits GROUP BY ALL),
per_query AS (SELECT query_id, count(DISTINCT token) AS tokens, (SELECT max(n) FROM per_row p WHERE p.query_id = h.query_id) AS most FROM hits h GROUP BY query_id),
matched AS (SELECT DISTINCT h.query_id, h.corpus_idx, h.word FROM hits h JOIN per_row USING (query_id, corpus_idx) JOIN per_query USING (query_id) WHERE n = tokens OR most < tokens),
tm AS (SELECT query_id, corpus_idx, round(sum(1.0::DOUBLE / ln(df + 2)), 6) AS score, array_to_string(list_sort(list(DISTINCT word)), '|') AS matched_words FROM matched JOIN df USING (word) GROUP BY ALL)"""


_TERM = _term_sql(f"SELECT * FROM (VALUES {_sql_values(TERMS)}) v(query_id, text)")

_POOL = f"""{_BM}, {_DENSE}, {_TERM},
l0 AS ({_top("bm", 50, ", '' AS matched_words")}), l1 AS ({_top("near", 50, ", '' AS matched_words")}), l2 AS ({_top("tm", 50, ", matched_words")}),
legs AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
  FROM (SELECT 0 AS leg, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2) WINDOW w AS (PARTITION BY leg, query_id)),
pool0 AS (SELECT query_id, corpus_idx, array_to_string(list_sort(list(DISTINCT CASE leg WHEN 0 THEN 'bm25' WHEN 1 THEN 'semantic' ELSE 'term' END)), '|') AS sources,
  {", ".join(f"coalesce(max(score) FILTER (leg = {i}), 0.0::DOUBLE) AS {n}, coalesce(max(norm) FILTER (leg = {i}), 0.0::DOUBLE) AS {n}_norm" for i, n in enumerate(fusion.LEGS))},
  coalesce(max(matched_words), '') AS matched_words, min(leg * 1000000 + rank) AS first FROM legs GROUP BY ALL),
pool AS (SELECT * EXCLUDE (first), CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, corpus_idx) AS INTEGER) AS place FROM pool0)"""


def _weighted(mode: str) -> str:
    a, b, c = fusion.mode_weights(mode)
    return f"round(bm25_norm * {a}::DOUBLE + semantic_norm * {b}::DOUBLE + term_norm * {c}::DOUBLE, 6)"


def _split_sql(threshold: float = 0.5) -> str:
    return f"""{_POOL}, scored AS (SELECT *, {_weighted("concept")} AS score FROM pool),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM scored),
split AS (SELECT *, CASE WHEN score >= {threshold}::DOUBLE AND rank <= 10 THEN 'strong' ELSE 'weak' END AS bucket FROM ranked)"""


_CHIPS = """SELECT query_id, word, count(*) AS n FROM (SELECT query_id, unnest(string_split(matched_words, '|')) AS word FROM split s
WHERE bucket = 'strong' OR NOT EXISTS (SELECT 1 FROM split x WHERE x.query_id = s.query_id AND x.bucket = 'strong')) WHERE word <> '' GROUP BY ALL"""

_EVAL = f"""
bw AS (SELECT item_id AS query_id, {TOKENS.format("text")} AS w FROM benchmark),
{_bm_sql("SELECT item_id AS query_id, text FROM benchmark").strip()},
grams AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM bw WHERE len(w) >= 5),
heldg AS (SELECT corpus_idx, unnest(list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i + 4], ' '))) AS gram FROM words WHERE len(toks) >= 5),
relevant AS (SELECT DISTINCT query_id, corpus_idx FROM heldg JOIN grams USING (gram)),
top100 AS ({_top("bm", 100)}),
flag AS (SELECT t.*, CASE WHEN r.corpus_idx IS NULL THEN 0 ELSE 1 END AS relevant FROM top100 t LEFT JOIN relevant r USING (query_id, corpus_idx)),
sums AS (SELECT query_id, count(*) AS n_retrieved, sum(relevant) FILTER (rank <= 10) AS top, sum(CASE WHEN rank <= 10 THEN relevant / log2(rank + 1) ELSE 0 END) AS dcg, sum(relevant) AS deep FROM flag GROUP BY query_id),
sizes AS (SELECT query_id, count(*) AS n_relevant FROM relevant GROUP BY query_id),
per_query_eval AS (SELECT query_id, n_relevant, coalesce(n_retrieved, 0) AS n_retrieved, round(coalesce(top, 0) / 10.0::DOUBLE, 4) AS precision,
  round(CASE WHEN n_retrieved > 0 THEN coalesce(top, 0) / CAST(least(10, n_retrieved) AS DOUBLE) ELSE 0 END, 4) AS precision_shown,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n_relevant) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg,
  round(coalesce(deep, 0) / CAST(n_relevant AS DOUBLE), 4) AS recall, round(coalesce(deep, 0) / CAST(n_relevant AS DOUBLE), 4) AS recall_set FROM sizes LEFT JOIN sums USING (query_id))"""

_SWEEP = f"""{_EVAL},
normed AS (SELECT query_id, corpus_idx, relevant, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM flag WINDOW w AS (PARTITION BY query_id)),
grid AS (SELECT i, round(i * 0.05::DOUBLE, 4) AS threshold FROM range(21) t(i)),
counts AS (SELECT threshold, query_id, count(*) FILTER (score >= threshold AND relevant = 1) AS tp, count(*) FILTER (score >= threshold AND relevant = 0) AS fp, count(*) FILTER (score < threshold AND relevant = 1) AS fn FROM normed, grid GROUP BY ALL),
pr AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS r FROM counts),
curve AS (SELECT threshold, round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4) AS macro_f1 FROM pr GROUP BY threshold)"""

VARIANTS = ["licensed under", "public license"]
_VARIANTS = f"SELECT * FROM (VALUES {_sql_values(list(enumerate(VARIANTS)))}) v(query_id, text)"
_NATURAL = f"""WITH {_bm_sql(_VARIANTS)}, {_term_sql(_VARIANTS)},
l0 AS ({_top("bm", 100)}), l2 AS ({_top("tm", 100)}),
legs AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
  FROM (SELECT 0 AS leg, * FROM l0 UNION ALL SELECT 2, * FROM l2) WINDOW w AS (PARTITION BY leg, query_id)),
pools AS (SELECT query_id, corpus_idx, max(norm) FILTER (leg = 0) AS b, max(norm) FILTER (leg = 2) AS t, min(leg * 1000000 + rank) AS first FROM legs GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, corpus_idx) AS place FROM pools),
merged AS (SELECT corpus_idx, round(sum(1.0::DOUBLE / (60 + place)), 9) AS rrf, max(coalesce(b, 0.0::DOUBLE)) AS b, max(coalesce(t, 0.0::DOUBLE)) AS t, min(query_id * 1000000 + place) AS first FROM placed GROUP BY corpus_idx),
scored AS (SELECT corpus_idx, round(b * 0.2::DOUBLE + 0 * 1.0::DOUBLE + t * 0.4::DOUBLE, 6) AS score, row_number() OVER (ORDER BY rrf DESC, first) AS place FROM merged),
ranked AS (SELECT corpus_idx, score, CAST(row_number() OVER (ORDER BY score DESC, place) AS INTEGER) AS rank FROM scored)
SELECT CASE WHEN rank <= 5 THEN 'strong' ELSE 'weak' END AS bucket, rank, corpus_idx, score FROM ranked"""
_MANY = f"SELECT * FROM (VALUES {_sql_values([(0, VARIANTS[0]), (1, VARIANTS[1]), (4, QUESTIONS[1][1]), (8, QUESTIONS[2][1])])}) v(query_id, text)"
_MANY_RANKED = f"""WITH {_bm_sql(_MANY)}, {_term_sql(_MANY)},
l0 AS ({_top("bm", 100)}), l2 AS ({_top("tm", 100)}),
legs AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
  FROM (SELECT 0 AS leg, * FROM l0 UNION ALL SELECT 2, * FROM l2) WINDOW w AS (PARTITION BY leg, query_id)),
pools AS (SELECT query_id, corpus_idx, max(norm) FILTER (leg = 0) AS b, max(norm) FILTER (leg = 2) AS t, min(leg * 1000000 + rank) AS first FROM legs GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, corpus_idx) AS place FROM pools),
merged AS (SELECT query_id // 4 AS q, corpus_idx, round(sum(1.0::DOUBLE / (60 + place)), 9) AS rrf, max(coalesce(b, 0.0::DOUBLE)) AS b, max(coalesce(t, 0.0::DOUBLE)) AS t, min(query_id * 1000000 + place) AS first FROM placed GROUP BY ALL),
scored AS (SELECT q, corpus_idx, round(b * 0.2::DOUBLE + 0 * 1.0::DOUBLE + t * 0.4::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, first) AS place FROM merged),
many AS (SELECT q AS query_id, corpus_idx, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, place) AS INTEGER) AS rank FROM scored)"""
_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> ''))"
_RERANKED = f"""WITH {_BM}, l0 AS ({_top("bm", 50)}),
sc AS (SELECT l0.query_id, l0.corpus_idx, l0.rank AS place, round(len(list_intersect({_WORDS.format("kq.text")}, {_WORDS.format("d.source || ' ' || d.text")})) / CAST(1 + len(string_split(kq.text, ' ')) AS DOUBLE), 6) AS score
  FROM l0 JOIN kq USING (query_id) JOIN documents d ON d.doc_id = l0.corpus_idx),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM sc)
SELECT query_id, corpus_idx, rank, score, CASE WHEN score >= 0.4::DOUBLE AND rank <= 10 THEN 'strong' ELSE 'weak' END AS bucket FROM ranked"""

_DIM = "dim AS (SELECT DISTINCT source AS slug, 'Sahih ' || upper(source) AS english_title FROM documents WHERE TRY_CAST(substr(source, 4) AS INTEGER) % 2 = 0)"
_CITE = "regexp_replace(string_split(number, ',')[1], '\\s+', '', 'g')"


def _snip(query: str) -> str:
    at = f"instr(lower(text), lower({query}))"
    start, end = f"greatest({at} - 81, 0)", f"least({at} - 1 + length({query}) + 80, length(text))"
    around = f"(CASE WHEN {start} > 0 THEN '…' ELSE '' END) || substring(text, {start} + 1, {end} - {start}) || (CASE WHEN {end} < length(text) THEN '…' ELSE '' END)"
    return f"CASE WHEN coalesce(text, '') = '' THEN '' WHEN {at} = 0 THEN (CASE WHEN length(text) > 160 THEN substring(text, 1, 160) || '…' ELSE text END) ELSE {around} END"


_TAGGED = "printf('[prematn]before [narrator id=\"%d\" role=\"first\" tooltip=\"T %s\"] %s [/narrator] and [narrator id=\"%d\" role=\"chain\" tooltip=\"\"]second' || chr(10) || 'name[/narrator] after', c_custkey, c_name, c_name, c_custkey + 1)"
_TAGLESS = "regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')"
_UNMARKED = f"regexp_replace({_TAGGED}, '\\[[^\\]]*\\]', '', 'g')"
_BODY = "' <p>' || role || ':' || chr(10) || '<p>' || coalesce(text, '') || chr(10) || chr(10) || chr(10) || chr(10) || 'end '"


def _clean_sql(x: str) -> str:
    return _strip(f"regexp_replace(replace({x}, '<p>', chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_GRADES = f"""WITH g AS (SELECT raw, lower(regexp_replace(strip_accents(CASE WHEN ltrim(raw) LIKE '[{{%' AND json_valid(raw) THEN coalesce(CAST(raw AS JSON)->0->>'grade', '') ELSE raw END), '[^a-zA-Z \\[\\]()]', '', 'g')) AS f FROM (VALUES {_sql_values([(g,) for g in GRADES])}) v(raw)),
c AS (SELECT raw, CASE WHEN f LIKE '%maudu%' OR f LIKE '%fabricated%' THEN 'maudu' WHEN f LIKE '%hasan sahih%' OR f LIKE '%sahih hasan%' THEN 'hasan_sahih' WHEN f LIKE '%muttafaqun%' OR f LIKE '%sahih%' THEN 'sahih'
  WHEN f LIKE '%hasan%' THEN 'hasan' WHEN f LIKE '%daif%' OR f LIKE '%weak%' THEN 'daif' ELSE 'ungraded' END AS cls FROM g)
SELECT doc_id, raw, cls, CAST(CASE cls WHEN 'sahih' THEN 0 WHEN 'hasan_sahih' THEN 1 WHEN 'hasan' THEN 2 WHEN 'daif' THEN 3 WHEN 'maudu' THEN 5 ELSE 4 END AS INTEGER) AS tier
  FROM (SELECT doc_id, ([{", ".join("'" + g.replace("'", "''") + "'" for g in GRADES)}])[(doc_id * 7 + coalesce(quality, 0) * 3 + coalesce(toxic, 0)) % {len(GRADES)} + 1] AS raw FROM labels) JOIN c USING (raw)"""

_WORK = "regexp_replace(regexp_replace(t, '^\\s+', ''), '^(<p>\\s*)+', '')"
_FIRST = f"{_strip(f'substr({_WORK}, 1, instr({_WORK}, chr(10)) - 1)')}"
_NARRATED = f"instr({_WORK}, chr(10)) > 0 AND {_FIRST} LIKE '%:' AND length({_FIRST}) <= 200"
_BUILT_TEXT = f"CASE WHEN {_NARRATED} THEN {_FIRST} ELSE '' END AS narrator, {_clean_sql(f'CASE WHEN {_NARRATED} THEN substr({_WORK}, instr({_WORK}, chr(10)) + 1) ELSE t END')} AS body"
_BARE = "regexp_replace({0}, '[\u064b-\u065f\u0670]', '', 'g')"
_ARABIC_HELD = f"aw AS (SELECT DISTINCT corpus_idx, unnest(regexp_extract_all({_BARE.format('arabic')}, '[\u0621-\u063a\u0641-\u064a]+')) AS word FROM built), adf AS (SELECT word, count(*) AS df FROM aw GROUP BY word)"
#: Which words a query's tokens find, by hand: the skeletons s-l-t, q-n-t, r-m-z-n and z-n.
_ARABIC_FOUND = "(VALUES (0, 0, 'صلاة'), (1, 0, 'قنوت'), (1, 1, 'رمضان'), (2, 0, 'أذان')) v(query_id, token, word)"
_ONE_BM = _bm_sql(f"SELECT * FROM (VALUES {_sql_values([KEYWORD[0]])}) v(query_id, text)")
_ONE_TERM = _term_sql(f"SELECT * FROM (VALUES {_sql_values([KEYWORD[0]])}) v(query_id, text)")


def _near_sql(text: str) -> str:
    """The dense leg of one text, encoded by its letters, as a table `axis`."""
    counts = _letters([text])[0]
    norm = sum(x * x for x in counts) ** 0.5
    unit = ", ".join(f"{x / norm!r}::DOUBLE" for x in counts)
    return f"axis AS (SELECT 0::BIGINT AS query_id, vec_id AS corpus_idx, round(list_dot_product(CAST(embedding AS DOUBLE[]), [{unit}]), 6) AS score FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE trim(coalesce(d.text, '')) <> '')"


_HEAD = "CASE WHEN length(text) > {0} THEN substring(text, 1, {0}) || '…' ELSE text END"

ORACLE_SQL = {
    "corpus_build": f"WITH {SOURCE_SQL} SELECT corpus_idx, collection, id_in_book, doc_id AS global_id, CAST(floor(bab) AS INTEGER) AS chapter_id, narrator, sha256(body) AS text_sha256, number, book, urn, grade, CAST(grade_tier AS INTEGER) AS grade_tier, tier FROM (SELECT *, {_BUILT_TEXT} FROM built)",
    "chapters": f"WITH {SOURCE_SQL} SELECT collection, book AS \"bookNumber\", bab AS \"babID\", coalesce(max(CASE WHEN trim(title) <> '' THEN title END), '') AS english_title, coalesce(max(arabic_title), '') AS arabic_title FROM src GROUP BY ALL",
    "chapters_of_collection": f"WITH {SOURCE_SQL} SELECT collection, CAST(floor(bab) AS INTEGER) AS id, book AS \"bookNumber\", bab AS \"babID\", coalesce(max(CASE WHEN trim(title) <> '' THEN title END), '') AS english_title, coalesce(max(arabic_title), '') AS arabic_title FROM src WHERE collection = 'src2' GROUP BY ALL",
    "seed_relevance": f"""WITH {SOURCE_SQL}, ch AS (SELECT collection, book, bab, coalesce(max(CASE WHEN trim(title) <> '' THEN title END), '') AS e, coalesce(max(arabic_title), '') AS a FROM src WHERE bab IS NOT NULL GROUP BY ALL),
hit AS (SELECT DISTINCT query, collection, book, bab FROM ch JOIN (VALUES ('a', '%EN 1%'), ('a', '%باب%'), ('b', '%de%')) v(query, pattern) ON e ILIKE pattern OR a LIKE pattern)
SELECT DISTINCT query, collection, number FROM src JOIN hit USING (collection, book, bab) WHERE number <> ''""",
    "table_report": "SELECT source AS collection, count(*) AS n FROM documents GROUP BY source",
    "record_with_chain": f"""WITH {SOURCE_SQL} SELECT corpus_idx, 'Sahih ' || upper(collection) AS english_title, narrator, CAST(1 AS INTEGER) AS n_chain, {arabic_word("doc_id + 2")} AS first_name,
{arabic_word("doc_id")} || '  ' || {arabic_word("doc_id + 2")} || '  ' || {arabic_word("doc_id // 3")} AS arabic,
'site/' || collection || ':' || (CASE WHEN number <> '' THEN {_CITE} ELSE CAST(id_in_book AS VARCHAR) END) AS reference FROM (SELECT *, {_BUILT_TEXT} FROM built)""",
    "get_record": f"""WITH {SOURCE_SQL}, mine AS (SELECT *, lower(replace(number, ' ', '')) AS n FROM built WHERE collection = 'src1'), found AS (
  SELECT 1 AS rule, '' AS tie, * FROM mine WHERE n = '1' UNION ALL SELECT 3, n, * FROM mine WHERE n = '1a' UNION ALL SELECT 4, '', * FROM mine WHERE id_in_book = 1)
SELECT corpus_idx, 'Sahih SRC1' AS english_title, number, 'src1:' || (CASE WHEN number <> '' THEN {_CITE} ELSE CAST(id_in_book AS VARCHAR) END) AS reference FROM found ORDER BY rule, tie, id_in_book LIMIT 1""",
    "arabic_word_frequency": f"WITH {SOURCE_SQL}, {_ARABIC_HELD} SELECT * FROM adf",
    "arabic_term_search": f"""WITH {SOURCE_SQL}, {_ARABIC_HELD}, hit AS (SELECT query_id, token, corpus_idx, word, df FROM {_ARABIC_FOUND} JOIN aw USING (word) JOIN adf USING (word)),
per AS (SELECT query_id, corpus_idx, count(DISTINCT token) AS n FROM hit GROUP BY ALL), al AS (SELECT h.query_id, count(DISTINCT token) AS tokens, (SELECT max(n) FROM per p WHERE p.query_id = h.query_id) AS most FROM hit h GROUP BY h.query_id),
am AS (SELECT query_id, corpus_idx, round(sum(1.0::DOUBLE / ln(df + 2)), 6) AS score FROM (SELECT DISTINCT query_id, corpus_idx, word, df FROM hit) JOIN per USING (query_id, corpus_idx) JOIN al USING (query_id) WHERE n = tokens OR most < tokens GROUP BY ALL) {_top("am", 50)}""",
    "response_summary": f"""WITH {_split_sql()}, chips AS ({_CHIPS}), said AS (SELECT query_id, string_agg(word || ':' || n, '|' ORDER BY n DESC, word) AS words FROM chips GROUP BY query_id), totals AS (SELECT query_id, count(*) AS total FROM split GROUP BY query_id)
SELECT v.query_id, v.text AS query, CASE WHEN total > 0 THEN least(10, total) ELSE 10 END AS "limit", coalesce(total, 0) AS total, coalesce(words, '') AS matched_words, CASE WHEN p.query_id IS NULL THEN NULL WHEN most = tokens THEN 'and' ELSE 'and_fallback_to_or' END AS match_logic,
  'term' AS mode_hint, coalesce(total, 0) AS pool_size, CASE WHEN total > 0 THEN 'overlap' ELSE 'none' END AS reranker, coalesce(total, 0) > 0 AS reranker_active, 'ok' AS reranker_status, CASE WHEN total > 0 THEN 0.5::DOUBLE END AS threshold
FROM (VALUES {_sql_values([*TERMS, (5, "nothing at all")])}) v(query_id, text) LEFT JOIN totals h USING (query_id) LEFT JOIN said s USING (query_id) LEFT JOIN per_query p USING (query_id)""",
    "plain_keyword_rows": f"""WITH {_BM}, {CORPUS_SQL}, {_DIM}, best AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, grade_tier, score DESC, corpus_idx) AS INTEGER) AS rank, corpus_idx, collection, id_in_book, number, grade, corpus.text FROM bm JOIN corpus USING (corpus_idx))
SELECT query_id, rank, corpus_idx, coalesce(english_title, collection) AS title, id_in_book, number, grade, {_snip("q")} AS snippet FROM (SELECT best.*, kq.text AS q FROM best JOIN kq USING (query_id) WHERE rank <= 10) LEFT JOIN dim ON slug = collection""",
    "plain_keyword_summary": f"""WITH {_BM}, {CORPUS_SQL} SELECT kq.query_id, kq.text AS query, (SELECT count(*) FROM bm JOIN corpus USING (corpus_idx) WHERE collection IN {_IN} AND bm.query_id = kq.query_id) AS total, 10::BIGINT AS "limit", 'src1,src2,src3' AS collections FROM kq""",
    "plain_term_rows": f"""WITH {_TERM}, {CORPUS_SQL}, {_DIM} SELECT query_id, rank, corpus_idx, coalesce(english_title, collection) AS title, id_in_book, number, grade, matched_words, {_HEAD.format(140)} AS snippet
FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, grade_tier, id_in_book, corpus_idx) AS INTEGER) AS rank, corpus_idx, collection, id_in_book, number, grade, matched_words, corpus.text FROM tm JOIN corpus USING (corpus_idx)) LEFT JOIN dim ON slug = collection WHERE rank <= 20""",
    "plain_term_summary": f"""WITH {_TERM}, counted AS (SELECT query_id, word, count(*) AS n FROM matched GROUP BY ALL), said AS (SELECT query_id, string_agg(word || ':' || n, '|' ORDER BY n DESC, word) AS words FROM counted GROUP BY query_id), sizes AS (SELECT query_id, count(*) AS total FROM tm GROUP BY query_id)
SELECT v.query_id, coalesce(total, 0) AS total, coalesce(words, '') AS matched_words, CASE WHEN p.query_id IS NULL THEN NULL WHEN most = tokens THEN 'and' ELSE 'and_fallback_to_or' END AS match_logic FROM (VALUES {_sql_values(TERMS)}) v(query_id, text) LEFT JOIN sizes z USING (query_id) LEFT JOIN said s USING (query_id) LEFT JOIN per_query p USING (query_id)""",
    "plain_semantic_rows": f"""WITH {_near_sql("any")}, {CORPUS_SQL}, {_DIM}, pooled AS ({_top("axis", 200)}), best AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, grade_tier, score DESC, corpus_idx) AS INTEGER) AS rank, corpus_idx, collection, id_in_book, number, grade, score AS similarity, text FROM pooled JOIN corpus USING (corpus_idx))
SELECT query_id, rank, corpus_idx, coalesce(english_title, collection) AS title, id_in_book, number, grade, similarity, {_HEAD.format(200)} AS snippet FROM best LEFT JOIN dim ON slug = collection WHERE rank <= 10""",
    "ranked_response": f"""WITH {_ONE_BM}, {_ONE_TERM}, {_near_sql(KEYWORD[0][1])}, {CORPUS_SQL}, {_DIM}, l0 AS ({_top("bm", 50)}), l1 AS ({_top("axis", 50)}), l2 AS ({_top("tm", 50)}),
legs AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM (SELECT 0 AS leg, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2) WINDOW w AS (PARTITION BY leg)),
pool AS (SELECT corpus_idx, {", ".join(f"coalesce(max(norm) FILTER (leg = {i}), 0.0::DOUBLE) AS {n}_norm" for i, n in enumerate(fusion.LEGS))}, min(leg * 1000000 + rank) AS first FROM legs GROUP BY corpus_idx),
ranked AS (SELECT corpus_idx, {_weighted("keyword")} AS score, CAST(row_number() OVER (ORDER BY {_weighted("keyword")} DESC, first, corpus_idx) AS INTEGER) AS rank FROM pool)
SELECT 0::BIGINT AS query_id, CASE WHEN rank <= 10 THEN 'strong' ELSE 'weak' END AS bucket, rank, corpus_idx, score, coalesce(english_title, collection) AS title, {_snip("q")} AS snippet FROM (SELECT ranked.*, collection, text, '{KEYWORD[0][1]}' AS q FROM ranked JOIN corpus USING (corpus_idx)) LEFT JOIN dim ON slug = collection""",
    "best_threshold_unrounded": "WITH " + _SWEEP.replace("round(avg(p), 4)", "avg(p)").replace("round(avg(r), 4)", "avg(r)").replace("round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4)", "avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)")
    + " SELECT threshold, round(macro_precision, 4) AS macro_precision, round(macro_recall, 4) AS macro_recall, round(macro_f1, 4) AS macro_f1 FROM curve ORDER BY round(macro_f1, 12) DESC, threshold LIMIT 1",
    "grade_classes": _GRADES,
    "natural_search": _NATURAL,
    "natural_many_rows": f"{_MANY_RANKED} SELECT query_id, CASE WHEN rank <= 5 THEN 'strong' ELSE 'weak' END AS bucket, rank, corpus_idx, score FROM many",
    "natural_many_summary": f"""{_MANY_RANKED} SELECT v.query_id, v.text AS query, 'concept' AS mode_hint, CASE WHEN v.query_id = 0 THEN '{"|".join(VARIANTS)}' ELSE '' END AS variants, CASE WHEN v.query_id > 0 THEN 'router_failed' END AS fallback,
      count(m.corpus_idx) AS pool_size, CASE WHEN count(m.corpus_idx) > 0 THEN least(5, count(m.corpus_idx)) ELSE 5 END AS "limit", 'none' AS reranker
      FROM (VALUES {_sql_values(QUESTIONS)}) v(query_id, text) LEFT JOIN many m USING (query_id) GROUP BY ALL""",
    "listwise_rank": f"""WITH {_BM}, l0 AS ({_top("bm", 50)}),
      held AS (SELECT l0.query_id, l0.corpus_idx, l0.rank AS place, len(list_intersect({_WORDS.format("kq.text")}, {_WORDS.format("d.source || ' ' || d.text")})) AS n FROM l0 JOIN kq USING (query_id) JOIN documents d ON d.doc_id = l0.corpus_idx),
      sc AS (SELECT *, round((rank() OVER (PARTITION BY query_id ORDER BY n) - 1) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE), 6) AS score FROM held),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM sc)
      SELECT query_id, corpus_idx, rank, score, CASE WHEN score >= 0.5::DOUBLE AND rank <= 10 THEN 'strong' ELSE 'weak' END AS bucket FROM ranked""",
    "reranked": _RERANKED,
    "bm25_topk": f"WITH {_BM} {_top('bm', 10)}",
    "table_round_trip": f"WITH {CORPUS_SQL} SELECT corpus_idx, collection, book, id_in_book, number, grade_tier FROM corpus",
    "vectors_round_trip": """WITH c AS (SELECT doc_id AS corpus_idx, list_transform(range(26), lambda i: CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(97 + CAST(i AS INTEGER)), '')) AS DOUBLE)) AS v FROM documents),
      u AS (SELECT corpus_idx, v, sqrt(list_dot_product(v, v)) AS norm FROM c)
      SELECT corpus_idx, round(coalesce(v[5] / nullif(norm, 0), 0), 4) AS e, round(coalesce(v[14] / nullif(norm, 0), 0), 4) AS n, round(coalesce(v[26] / nullif(norm, 0), 0), 4) AS z FROM u""",
    "query_set_round_trip": "SELECT text, CASE WHEN item_id % 2 = 0 THEN 'keyword' ELSE 'concept' END AS mode, 'c' || (item_id % 3) AS collection, CAST(item_id AS VARCHAR) AS number FROM benchmark",
    "eval_latency": f"""WITH {_EVAL}, shown AS ({_top("bm", 10)}) SELECT count(*) AS n_queries, round(avg(precision), 4) AS precision, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall,
      (SELECT count(*) FROM benchmark) AS timed, (SELECT count(*) FROM shown) AS rows, true AS took_time FROM per_query_eval""",
    "collection_lines": f"WITH {_DIM}, n AS (SELECT source AS slug, count(*) AS n FROM documents GROUP BY source) SELECT slug, '- ' || slug || ': ' || coalesce(english_title, slug) || ' — ' || format('{{:,}}', n) || ' texts' AS line FROM n LEFT JOIN dim USING (slug)",
    "chapter_lines": f"""WITH {SOURCE_SQL} SELECT collection, book AS "bookNumber", bab AS "babID", lpad(coalesce(CAST(CAST(floor(bab) AS INTEGER) AS VARCHAR), '—'), 6, ' ') || '  ' || coalesce(max(CASE WHEN trim(title) <> '' THEN title END), '') AS line FROM src GROUP BY collection, book, bab""",
    "keyword_summary_lines": f"""WITH {_bm_sql(f"SELECT * FROM (VALUES {_sql_values([*KEYWORD, (3, 'zzzqqq')])}) v(query_id, text)")}, {CORPUS_SQL},
      t AS (SELECT kq.query_id, kq.text, (SELECT count(*) FROM bm JOIN corpus USING (corpus_idx) WHERE bm.query_id = kq.query_id AND collection IN {_IN}) AS total FROM kq)
      SELECT query_id, CASE WHEN total = 0 THEN 'No matches for ''' || text || ''' in {", ".join(PICKED)}.' ELSE 'Found ' || total || ' text(s) in {", ".join(PICKED)} matching ''' || text || '''.' || CASE WHEN total > 10 THEN chr(10) || 'Showing first 10:' ELSE '' END END AS line FROM t""",
    "record_lines": f"""WITH {SOURCE_SQL} SELECT corpus_idx, concat_ws(chr(10), 'Sahih ' || upper(collection) || ' #' || (CASE WHEN number <> '' THEN number ELSE CAST(id_in_book AS VARCHAR) END) || (CASE WHEN grade <> '' THEN ' — ' || grade ELSE '' END),
      nullif(narrator, ''), nullif(body, ''), chr(10) || 'Arabic:' || chr(10) || {arabic_word("doc_id")} || '  ' || {arabic_word("doc_id + 2")} || '  ' || {arabic_word("doc_id // 3")},
      'Chain of narration:' || chr(10) || '  1. ' || {arabic_word("doc_id + 2")} || '  (first)', 'Reference: site/' || collection || ':' || (CASE WHEN number <> '' THEN {_CITE} ELSE CAST(id_in_book AS VARCHAR) END)) AS line FROM (SELECT *, {_BUILT_TEXT} FROM built)""",
    "blockmax_topk": f"WITH {_bm_sql('SELECT item_id AS query_id, text FROM benchmark')} {_top('bm', 10)}",
    "dense_exact_topk": f"WITH {_DENSE} {_top('near_all', 20)}",
    "refreshed_topk": f"WITH {_BM} {_top('bm', 10)}",
    "refresh_report": """WITH d AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 <> 0) AS early, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 = 0) AS changed FROM documents)
      SELECT 0::BIGINT AS batch, early AS added, 0::BIGINT AS replaced, 0::BIGINT AS removed, 0::BIGINT AS unchanged FROM d
      UNION ALL SELECT 1, n - early, changed, 0, early - changed FROM d UNION ALL SELECT 2, 0, 0, 0, n FROM d""",
    "dump_round_trip": """SELECT c_custkey, c_name || ' ''q'' "d" \\ ' || chr(10) || chr(9) || chr(13) || ', ) (;' AS note, CAST(c_acctbal AS DOUBLE) AS c_acctbal,
      CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment FROM customer""",
    "bm25_collections": f"WITH {_BM}, {CORPUS_SQL} {_top('bm', 10, '', _PICK)}",
    "bm25_term_statistics": f"WITH {_BM} SELECT term, df, round(CASE WHEN i < 0 THEN 0.25::DOUBLE * mean_idf ELSE i END, 6) AS idf FROM (SELECT term, df, mean_idf, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS i FROM terms, stats)",
    "bm25_lengths": f"WITH {_BM} SELECT * FROM lengths",
    "tiered_keyword": f"""WITH {_BM}, {CORPUS_SQL} SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, grade_tier, score DESC, corpus_idx) AS INTEGER) AS rank, corpus_idx, score, count(*) OVER (PARTITION BY query_id) AS total FROM bm JOIN corpus USING (corpus_idx)) WHERE rank <= 20""",
    "list_collections": f"WITH {_DIM} SELECT source AS slug, coalesce(english_title, source) AS english_title, count(*) AS n FROM documents LEFT JOIN dim ON source = slug GROUP BY ALL",
    "list_books": f"WITH {SOURCE_SQL} SELECT collection, CAST(floor(bab) AS INTEGER) AS id, book AS \"bookNumber\", bab AS \"babID\", coalesce(max(CASE WHEN trim(title) <> '' THEN title END), '') AS english_title, coalesce(max(arabic_title), '') AS arabic_title FROM src WHERE collection = 'src0' GROUP BY ALL",
    "random_row": f"WITH {CORPUS_SQL} SELECT corpus_idx, collection FROM corpus ORDER BY sha256('7:' || corpus_idx) LIMIT 1",
    "random_row_of_collection": f"WITH {CORPUS_SQL} SELECT corpus_idx, collection FROM corpus WHERE collection = 'src3' ORDER BY sha256('11:' || corpus_idx) LIMIT 1",
    "drawn_rows": f"WITH {CORPUS_SQL} SELECT corpus_idx, collection FROM corpus QUALIFY row_number() OVER (PARTITION BY collection ORDER BY sha256('5:' || corpus_idx)) <= 3",
    "patterns_any_of": """WITH w AS (SELECT item_id AS query, string_split(text, ' ') AS w FROM benchmark),
      p AS (SELECT DISTINCT query, '%' || array_to_string(w[i:i + 2], '_') || '%' AS pattern FROM (SELECT query, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))
      SELECT query, doc_id, count(*) AS n FROM documents JOIN p ON text ILIKE pattern GROUP BY ALL""",
    "lookup_ladder": f"""WITH {CORPUS_SQL}, keys AS (SELECT key_id, collection, {_strip("key")} AS key FROM (VALUES {_sql_values(KEYS)}) v(key_id, collection, key)),
sq AS (SELECT *, lower(replace(number, ' ', '')) AS n FROM corpus), k AS (SELECT *, lower(replace(key, ' ', '')) AS s FROM keys),
found AS (
  SELECT key_id, 1 AS rule, '' AS tie, id_in_book, corpus_idx FROM k JOIN sq USING (collection) WHERE n = s
  UNION ALL SELECT key_id, 2, '', id_in_book, corpus_idx FROM k JOIN sq USING (collection) WHERE contains(number, ',') AND list_contains(string_split(n, ','), s)
  UNION ALL SELECT key_id, 3, n, id_in_book, corpus_idx FROM k JOIN sq USING (collection) WHERE regexp_full_match(s, '[0-9]+') AND starts_with(n, s) AND regexp_full_match(substr(n, length(s) + 1), '[a-z]+')
  UNION ALL SELECT key_id, 4, '', id_in_book, corpus_idx FROM k JOIN sq USING (collection) WHERE TRY_CAST(key AS BIGINT) = id_in_book)
SELECT key_id, CAST(rule AS INTEGER) AS rule, corpus_idx FROM found QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY rule, tie, id_in_book) = 1""",
    "record": f"""WITH {SOURCE_SQL} SELECT corpus_idx, 'Sahih ' || upper(collection) AS english_title, id_in_book, narrator, CAST(1 AS INTEGER) AS n_chain,
      collection || ':' || CASE WHEN number = '' THEN CAST(id_in_book AS VARCHAR) ELSE {_CITE} END AS reference FROM (SELECT *, {_BUILT_TEXT} FROM built)""",
    "parse_references": """SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN upper(source) || ' #' || doc_id WHEN 1 THEN ' Sahih ' || source || ' ' || doc_id || ', ' || (doc_id + 1) ELSE source || '#' || doc_id || 'b ' END AS reference,
      source AS slug, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN doc_id || ', ' || (doc_id + 1) ELSE doc_id || 'b' END AS number FROM documents WHERE doc_id % 4 <> 2 AND TRY_CAST(substr(source, 4) AS INTEGER) % 2 = 0""",
    "tokenise": f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM documents",
    "snippet": f"SELECT doc_id, {_snip(chr(39) + 'The ' + chr(39))} AS snippet, CASE WHEN length(text) > 140 THEN substring(text, 1, 140) || '…' ELSE text END AS head FROM documents",
    "split_narrator": f"SELECT conv_id, turn, role || ':' AS narrator, {_clean_sql('substr(t, instr(t, chr(10)) + 1)')} AS body FROM (SELECT *, {_BODY} AS t FROM conversations)",
    "clean_html": f"SELECT page_id, {_strip(_TAGLESS)} AS text, length({_clean_sql('html')}) AS n FROM pages",
    "narrator_chain": f"""SELECT c_custkey, CAST(i AS INTEGER) AS position, CAST(c_custkey + i AS INTEGER) AS id, CASE i WHEN 0 THEN 'first' ELSE 'chain' END AS role, CASE i WHEN 0 THEN 'T ' || c_name ELSE '' END AS tooltip, CASE i WHEN 0 THEN c_name ELSE 'second' || chr(10) || 'name' END AS inline_name FROM customer, range(2) r(i)""",
    "strip_markup": f"SELECT c_custkey, {_strip(_UNMARKED)} AS text FROM customer",
    "embedding_text": "SELECT conv_id, turn, concat_ws(' ', nullif(CASE WHEN turn % 2 = 0 THEN role ELSE '' END, ''), nullif(text, '')) AS text FROM conversations",
    "eval_keys": f"WITH {CORPUS_SQL} SELECT corpus_idx, lower(trim(string_split(number, ',')[1])) AS key, {_CITE} AS cite FROM corpus",
    "dense_topk": f"WITH {_DENSE} {_top('near', 20)}",
    "dense_scores": f"WITH {_DENSE} SELECT * FROM near_all",
    "dense_tiered": f"""WITH {_DENSE}, {CORPUS_SQL}, pooled AS ({_top('near', 200)}) SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, grade_tier, score DESC, corpus_idx) AS INTEGER) AS rank, corpus_idx, score FROM pooled JOIN corpus USING (corpus_idx)) WHERE rank <= 10""",
    "skeletons": f"WITH {_TERM} SELECT word, coalesce(array_to_string(list_sort(list(DISTINCT skeleton)), '|'), '') AS skeletons FROM df LEFT JOIN fold USING (word) GROUP BY word",
    "term_document_frequency": f"WITH {_TERM} SELECT * FROM df",
    "term_search": f"WITH {_TERM} {_top('tm', 20, ', matched_words')}",
    "term_collections": f"WITH {_TERM}, {CORPUS_SQL} {_top('tm', 20, '', _PICK)}",
    "term_word_counts": f"WITH {_TERM} SELECT query_id, word, count(*) AS n FROM matched GROUP BY ALL",
    "match_logic": f"WITH {_TERM} SELECT v.query_id, CASE WHEN p.query_id IS NULL THEN NULL WHEN most = tokens THEN 'and' ELSE 'and_fallback_to_or' END AS match_logic FROM (VALUES {_sql_values(TERMS)}) v(query_id, text) LEFT JOIN per_query p USING (query_id)",
    "match_logic_collections": f"""WITH {_TERM}, {CORPUS_SQL}, inside AS (SELECT h.* FROM hits h JOIN corpus USING (corpus_idx) WHERE collection IN {_IN}),
pr AS (SELECT query_id, corpus_idx, count(DISTINCT token) AS n FROM inside GROUP BY ALL), pq AS (SELECT query_id, count(DISTINCT token) AS tokens, (SELECT max(n) FROM pr WHERE pr.query_id = i.query_id) AS most FROM inside i GROUP BY query_id)
SELECT v.query_id, CASE WHEN pq.query_id IS NULL THEN NULL WHEN most = tokens THEN 'and' ELSE 'and_fallback_to_or' END AS match_logic FROM (VALUES {_sql_values(TERMS)}) v(query_id, text) LEFT JOIN pq USING (query_id)""",
    "term_tiered": f"""WITH {_TERM}, {CORPUS_SQL} SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, grade_tier, id_in_book, corpus_idx) AS INTEGER) AS rank, corpus_idx, count(*) OVER (PARTITION BY query_id) AS total FROM tm JOIN corpus USING (corpus_idx)) WHERE rank <= 20""",
    "union_pool": f"WITH {_POOL} SELECT query_id, corpus_idx, sources, {', '.join(f'round({n}, 6) AS {n}, round({n}_norm, 6) AS {n}_norm' for n in fusion.LEGS)}, matched_words, place FROM pool",
    **{f"weighted_{m}": f"WITH {_POOL} SELECT query_id, corpus_idx, place, {_weighted(m)} AS score FROM pool" for m in ("concept", "keyword", "term")},
    "strong_weak_split": f"WITH {_split_sql()} SELECT query_id, rank, corpus_idx, score, bucket FROM split",
    "hydrated_rows": f"""WITH {_split_sql()}, {CORPUS_SQL}, {_DIM} SELECT query_id, rank, bucket, coalesce(english_title, collection) AS title, id_in_book, number, grade, snippet, nullif(matched_words, '') AS matched_words, similarity FROM (
SELECT s.query_id, s.rank, s.bucket, c.collection, c.id_in_book, c.number, c.grade, {_snip("kq.text").replace("(text", "(c.text").replace("THEN text", "THEN c.text").replace("ELSE text", "ELSE c.text")} AS snippet, s.matched_words, CASE WHEN contains(sources, 'semantic') THEN round(semantic, 6) END AS similarity
FROM split s JOIN corpus c USING (corpus_idx) JOIN kq USING (query_id)) LEFT JOIN dim ON slug = collection""",
    "chip_words": f"WITH {_split_sql()} {_CHIPS}",
    "chip_words_weak": f"WITH {_split_sql(2.0)} {_CHIPS}",
    "facets": f"WITH {_split_sql()}, {CORPUS_SQL} SELECT query_id, collection, count(*) AS n FROM split JOIN corpus USING (corpus_idx) GROUP BY ALL",
    "facet_order": f"WITH {_DIM}, c AS (SELECT DISTINCT source AS slug, coalesce(english_title, source) AS english_title FROM documents LEFT JOIN dim ON source = slug) SELECT slug, english_title, CAST(row_number() OVER (ORDER BY english_title, slug) AS INTEGER) AS position FROM c",
    "merged_order": f"WITH {_split_sql()} SELECT query_id, bucket, corpus_idx, CAST(row_number() OVER (PARTITION BY query_id, bucket ORDER BY coalesce(nullif(CASE WHEN corpus_idx % 3 = 0 THEN 0.0::DOUBLE ELSE score END, 0), nullif(round(semantic, 6), 0), 0) DESC, corpus_idx) AS INTEGER) AS rank FROM split",
    "facet_filter": f"WITH {_split_sql()}, {CORPUS_SQL} SELECT query_id, corpus_idx, collection FROM split JOIN corpus USING (corpus_idx) WHERE collection IN {_IN}",
    "page_2": f"WITH {_split_sql()} SELECT query_id, place AS at, corpus_idx FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bucket, rank) AS INTEGER) AS place, corpus_idx FROM split) WHERE place > 10 AND place <= 20",
    "rrf_merge": f"""WITH {_POOL}, two AS (SELECT query_id, corpus_idx, max(score) FILTER (leg = 0) AS b, max(score) FILTER (leg = 2) AS t, array_to_string(list_sort(list(DISTINCT CASE leg WHEN 0 THEN 'bm25' ELSE 'term' END)), '|') AS sources, min(leg * 1000000 + rank) AS first FROM legs WHERE leg <> 1 AND query_id < 3 GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, corpus_idx) AS place FROM two)
SELECT corpus_idx, round(sum(1.0::DOUBLE / (60 + place)), 9) AS rrf, round(max(coalesce(b, 0.0::DOUBLE)), 6) AS bm25, round(max(coalesce(t, 0.0::DOUBLE)), 6) AS term, array_to_string(list_sort(list_distinct(flatten(list(string_split(sources, '|'))))), '|') AS sources FROM placed GROUP BY corpus_idx""",
    "eval_per_query": f"WITH {_EVAL} SELECT * FROM per_query_eval",
    "eval_macro": f"WITH {_EVAL} SELECT count(*) AS n_queries, round(avg(precision), 4) AS precision, round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall FROM per_query_eval",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM curve",
    "best_threshold": f"WITH {_SWEEP} SELECT * FROM curve ORDER BY macro_f1 DESC, threshold LIMIT 1",
    "load_report": "SELECT source AS collection, count(*) AS n FROM documents GROUP BY source",
    "seed_labels": "SELECT DISTINCT query, doc_id FROM documents JOIN (VALUES ('a', '%licensed%'), ('a', '%THE THE%'), ('b', '%password%')) v(query, pattern) ON text ILIKE pattern",
}
