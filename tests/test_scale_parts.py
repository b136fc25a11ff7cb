"""Ordinals by ranges, patterns by one automaton, keyed draws and joins of hot keys: equal to plain versions, and split."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import corpus, patterns, sizes, term
from quern.operators.ordinal import numbered


def test_places_are_those_of_a_sort_and_no_task_has_a_book(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice(["7", "7", "7", "10", "2", "", None, "x"]), rng.choice([None, 0.5, 1.5, 2.0]), i) for i in range(3000)]
    rows += [("big", "1", 1.0, 10_000 + i) for i in range(2000)]  # two fifths of all rows are one book
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        frame = spark.createDataFrame(rows, "collection string, bookNumber string, babID double, arabicURN long").repartition(8)
        found = {r["arabicURN"]: r["id_in_book"] for r in corpus.ordinals(frame).collect()}
        ranged = frame.repartitionByRange("collection", "bookNumber", "babID", "arabicURN").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number = lambda b: int(b) if (b or "").isdigit() else 0
    for name in ("a", "b", "big", None):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (number(r[1]), r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[3]))
        assert [found[r[3]] for r in own] == [*range(1, len(own) + 1)]
    counts = sorted(r["count"] for r in ranged)
    assert len(counts) >= 12 and counts[-1] <= 2 * counts[len(counts) // 2]


def test_places_of_nothing_and_of_one_group(spark):
    empty = spark.createDataFrame([], "g string, k long")
    assert numbered(empty, "g", [F.col("k").asc()], "n").collect() == []
    one = spark.createDataFrame([("x", i % 50) for i in range(200)], "g string, k long")  # equal keys share no place
    assert sorted(r["n"] for r in numbered(one, "g", [F.col("k").asc()], "n").collect()) == [*range(1, 201)]


def plain_like(text, pattern):
    """LIKE by dynamic programming."""
    parts, escaped = [], False
    for c in pattern:
        if not escaped and c == "\\":
            escaped = True
            continue
        parts.append((c, not escaped and c in "%_"))
        escaped = False
    reach = {0}
    for c, wild in parts:
        if wild and c == "%":
            reach = set(range(min(reach), len(text) + 1)) if reach else set()
        else:
            reach = {i + 1 for i in reach if i < len(text) and (wild or text[i] == c)}
    return len(text) in reach


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("most", [3, 1000])
def test_any_of_is_like_for_every_pattern(spark, monkeypatch, fold, most):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abAB %_é\n", k=rng.randrange(12))) for _ in range(150)] + ["", None, "ab" * 2000]
    asked = [("q", p) for p in ("%", "_%", "", "%ab%", "a%", "%b_a%", "%A%b%", "%\\%%", "\\_%", "%é%", "%abab%", None)] + [("r", "%" + "".join(rng.choices("abAB", k=3)) + "%") for _ in range(20)] + [("r", "%ab%")]
    monkeypatch.setattr(patterns, "MOST_PATTERNS", most)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {(r["id"], r["query"], r["pattern"]) for r in patterns.any_of(rows, ["id"], "text", spark.createDataFrame(asked, "query string, pattern string"), fold).collect()}
    low = (lambda x: x.lower()) if fold else (lambda x: x)
    assert found == {(i, q, p) for i, t in enumerate(texts) if t is not None for q, p in asked if p is not None and plain_like(low(t), low(p))}


def test_any_of_without_patterns(spark):
    rows = spark.createDataFrame([(1, "x")], "id long, text string")
    assert patterns.any_of(rows, ["id"], "text", spark.createDataFrame([], "query string, pattern string")).collect() == []


def test_texts_are_sent_once_however_many_patterns_they_hold():
    texts = ["alpha beta gamma " + "x" * 2000] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], names=["id", "__text"])
    asked = [(i, "%alpha" + ("_beta" if i % 2 else "__beta") + "%" + "x" * (1 + i % 4)) for i in range(2000)]
    sent = list(patterns._candidates([batch], asked))
    assert sum(b.num_rows for b in sent) == 100 and sum(len(r) for b in sent for r in b.column("__patterns").to_pylist()) == 100 * 1000
    assert sum(b.nbytes for b in sent) < 2 * batch.nbytes + 4 * 100 * 1000


def test_literal_parts():
    assert [patterns.literal(p) for p in ("%abc%de_f%", "%", "a\\%b%cc", "", "\\")] == ["abc", "", "a%b", "", ""]


def test_draws_repeat_merge_and_are_even(spark):
    rows = spark.createDataFrame([(i, f"c{i % 3}") for i in range(300)], "corpus_idx long, collection string")
    draw = lambda df, seed, by=None: sorted(r["corpus_idx"] for r in corpus.drawn(df, 4, seed, by).collect())
    assert draw(rows, 1) == draw(rows.repartition(13), 1) != draw(rows, 2)
    halves = rows.where("corpus_idx < 150"), rows.where("corpus_idx >= 150")
    merged = corpus.drawn(halves[0], 4, 1).unionByName(corpus.drawn(halves[1], 4, 1))
    assert draw(merged, 1) == draw(rows, 1)
    each = corpus.drawn(rows, 4, 3, "collection").groupBy("collection").count().collect()
    assert sorted(map(tuple, each)) == [("c0", 4), ("c1", 4), ("c2", 4)]
    hits = [0] * 3
    for seed in range(60):
        hits[corpus.random_row(rows, seed=seed).first()["corpus_idx"] // 100] += 1
    assert min(hits) >= 8
    assert corpus.random_row(rows, "c1", 5).first()["collection"] == "c1" and corpus.random_row(rows, "none").collect() == []


def test_a_key_that_all_rows_have_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sizes, "FREQUENT", 50)
    many = spark.createDataFrame([(i, "the" if i % 10 else f"w{i}") for i in range(5000)], "id long, word string")
    one = many.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("form", F.explode(F.array(F.lit("x"), F.lit("y"))))
    joined = sizes.join_counted(many, one, "word", "df", 5000)
    assert sorted(map(tuple, joined.select("id", "word", "df", "form").collect())) == sorted(map(tuple, many.join(one, "word").select("id", "word", "df", "form").collect()))
    assert one.where("word = 'the'").first()["df"] == 4500


def test_term_postings_of_a_word_in_all_rows(spark, monkeypatch, tmp_path):
    texts = spark.createDataFrame([(i, f"salat word{i % 7} salat") for i in range(400)], "corpus_idx long, text string")
    whole = sorted(map(tuple, term.build(texts, term.T.latin_words, "text").postings.select("skeleton", "corpus_idx", "word", "df").collect()))
    monkeypatch.setattr(sizes, "FREQUENT", 20)
    index = term.build(texts, term.T.latin_words, "text")
    index.write(str(tmp_path))
    assert sorted(map(tuple, term.Index.read(spark, str(tmp_path)).postings.select("skeleton", "corpus_idx", "word", "df").collect())) == whole
