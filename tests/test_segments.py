"""A store that grows by segments equals a rebuild; a repeated change is none; a change is seen whole or not at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import bm25, dense
from quern.streaming.refresh import chained
from quern.streaming.segments import Store

SCHEMA = "corpus_idx long, text string, tag string"
FIRST = [(i, f"alpha w{i % 7} beta{i % 3}", "a") for i in range(40)] + [(50, None, "a"), (51, "", None)]
SECOND = [(3, "gamma replaces alpha", "a"), (4, "alpha w4 beta1", "a"), (60, "new gamma row w1", "b"), (60, "new gamma row w1", "b"), (None, "no id", "b")]
QUESTIONS = [(0, "alpha gamma"), (1, "w4 beta1 w1"), (2, "replaces row")]


def hashed():
    """Texts as bags of hashed words; every text that is encoded is recorded where tests can count it."""

    def encode(texts):
        out = np.zeros((len(texts), 16))
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, sum(w.encode()) % 16] += 1
        return out

    return encode


def plain(df):
    return sorted(map(str, map(tuple, df.collect())))


def found(index, spark):
    return plain(bm25.top(bm25.scores(index, spark.createDataFrame(QUESTIONS, "query_id long, text string")), 20).select("query_id", "rank", "corpus_idx", "score"))


def same_as_rebuilt(store, spark, rows):
    """The store's tables, index and vectors are those of building from rows."""
    corpus = spark.createDataFrame(rows, SCHEMA)
    assert plain(store.rows().select("corpus_idx", "text", "tag")) == plain(corpus)
    built = bm25.build(corpus)
    assert found(store.index(), spark) == found(built, spark)
    assert plain(store.index().terms.select("term", "df", F.round("idf", 9))) == plain(built.terms.select("term", "df", F.round("idf", 9)))
    assert plain(store.index().lengths) == plain(built.lengths)
    assert plain(store.vectors()) == plain(dense.build(corpus, hashed))


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_two_changes_equal_a_rebuild_and_a_third_changes_nothing(spark, store):
    assert store.rows() is None and store.index() is None and store.vectors() is None
    assert store.apply(spark.createDataFrame(FIRST, SCHEMA), "one", hashed) == {"batch": "one", "added": 42, "replaced": 0, "removed": 0, "unchanged": 0}
    same_as_rebuilt(store, spark, FIRST)
    assert store.apply(spark.createDataFrame(SECOND, SCHEMA), "two", hashed) == {"batch": "two", "added": 1, "replaced": 1, "removed": 0, "unchanged": 1}
    whole = [r for r in FIRST if r[0] != 3] + [SECOND[0], SECOND[2]]
    same_as_rebuilt(store, spark, whole)
    before = store.manifest()
    assert store.apply(spark.createDataFrame(SECOND, SCHEMA), "two", hashed)["unchanged"] == 0  # known by its name
    assert store.apply(spark.createDataFrame(SECOND, SCHEMA), "again", hashed) == {"batch": "again", "added": 0, "replaced": 0, "removed": 0, "unchanged": 3}
    assert store.manifest() == before
    vectors = [spark.read.parquet(f"{store.path}/segments/{s}/vectors").count() for s in before["segments"]]
    assert vectors == [42, 2]  # only changed rows are encoded
    store.compact()
    assert len(store.manifest()["segments"]) == 1
    same_as_rebuilt(store, spark, whole)
    assert store.vacuum() == 2
    same_as_rebuilt(store, spark, whole)
    store.apply(spark.createDataFrame([(3, "alpha w3 beta0", "a")], SCHEMA), "back", hashed)
    same_as_rebuilt(store, spark, [*FIRST, SECOND[2]])


def test_rows_that_a_snapshot_lacks_are_removed(spark, store):
    store.apply(spark.createDataFrame(FIRST, SCHEMA), "one", hashed)
    said = store.apply(spark.createDataFrame(FIRST[:10] + SECOND[2:3], SCHEMA), "two", hashed, snapshot=True)
    assert (said["added"], said["removed"], said["unchanged"]) == (1, 32, 10)
    same_as_rebuilt(store, spark, FIRST[:10] + SECOND[2:3])
    said = store.apply(spark.createDataFrame(FIRST[:11], SCHEMA), "three", hashed)  # one comes back
    assert (said["added"], said["unchanged"]) == (1, 10)
    same_as_rebuilt(store, spark, FIRST[:11] + SECOND[2:3])


def test_a_change_that_fails_leaves_the_last_state(spark, store):
    store.apply(spark.createDataFrame(FIRST, SCHEMA), "one", hashed)

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        store.apply(spark.createDataFrame(SECOND, SCHEMA), "two", broken)
    same_as_rebuilt(store, spark, FIRST)
    assert store.apply(spark.createDataFrame(SECOND, SCHEMA), "two", hashed)["added"] == 1


def test_two_writers_of_one_version(spark, store):
    store.apply(spark.createDataFrame(FIRST, SCHEMA), "one", hashed)
    stale = store.manifest()
    store.apply(spark.createDataFrame(SECOND, SCHEMA), "two", hashed)
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(stale | {"version": stale["version"] + 1})


def test_files_are_chained_to_table_index_and_vectors(spark, store, tmp_path):
    drops, checkpoint = str(tmp_path / "drops"), str(tmp_path / "checkpoint")
    schema = spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame(FIRST, SCHEMA).coalesce(1).write.parquet(drops)
    assert [s["added"] for s in chained(spark, drops, schema, checkpoint, store, hashed)] == [42]
    spark.createDataFrame(SECOND, SCHEMA).coalesce(1).write.mode("append").parquet(drops)
    assert [(s["added"], s["replaced"]) for s in chained(spark, drops, schema, checkpoint, store, hashed)] == [(1, 1)]
    assert chained(spark, drops, schema, checkpoint, store, hashed) == []
    same_as_rebuilt(store, spark, [r for r in FIRST if r[0] != 3] + [SECOND[0], SECOND[2]])
