"""A change is judged by ids and digests: its texts are not shuffled, and rows of repeated ids are still one an id."""

import pytest
from pyspark.sql import functions as F

from quern.streaming import segments
from quern.streaming.segments import Store

SCHEMA = "corpus_idx long, text string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def plans(monkeypatch):
    """The plans of what is written into segments as changed rows."""
    seen, plain = [], Store._write

    def write(self, path, changed, *more):
        seen.append(_plan(changed))
        return plain(self, path, changed, *more)

    monkeypatch.setattr(Store, "_write", write)
    return seen


def _held(store):
    return sorted(map(tuple, store.rows().select("corpus_idx", "text").collect()))


def test_texts_of_a_change_are_not_shuffled(spark, tmp_path, plans):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.range(500).select(F.col("id").alias("corpus_idx"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    store.apply(rows.where("corpus_idx < 300"), "one")
    said = store.apply(rows.withColumn("text", F.when(F.col("corpus_idx") % 5 == 0, F.lit("new")).otherwise(F.col("text"))), "two")
    assert (said["added"], said["replaced"], said["unchanged"]) == (200, 60, 240)
    assert "Join" not in plans[0] and "Exchange" not in plans[0]
    assert "BroadcastHashJoin" in plans[1] and "Exchange hashpartitioning" not in plans[1] and "Aggregate" not in plans[1]
    assert _held(store) == [(i, "new" if i % 5 == 0 else f"some words {i}") for i in range(500)]


@pytest.mark.parametrize("most", [0, segments.MOST_IDS])
def test_rows_of_repeated_ids(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(segments, "MOST_IDS", most)
    store = Store(spark, str(tmp_path / "store"))
    first = [(i, f"a{i} b") for i in range(30)]
    assert store.apply(spark.createDataFrame([*first, first[3], (7, "other b"), (None, "x")], SCHEMA), "one")["added"] == 30
    held = dict(_held(store))
    assert len(_held(store)) == 30 and held.pop(7) in ("a7 b", "other b") and held == {i: t for i, t in first if i != 7}
    seven = dict(_held(store))[7]
    second = [(1, "a1 b"), (1, "a1 b"), (2, "new two"), (2, "new two"), (4, "new four"), (7, seven), (50, None), (51, "z z"), (51, "z z")]
    said = store.apply(spark.createDataFrame(second, SCHEMA), "two")
    assert (said["added"], said["replaced"], said["unchanged"]) == (2, 2, 2)
    want = dict(first) | {7: seven, 2: "new two", 4: "new four", 50: None, 51: "z z"}
    assert _held(store) == sorted(want.items())
    said = store.apply(spark.createDataFrame([(2, "new two"), (51, "z"), (51, "z")], SCHEMA), "three", snapshot=True)
    assert (said["replaced"], said["removed"], said["unchanged"]) == (1, 30, 1)
    assert _held(store) == [(2, "new two"), (51, "z")]
    assert sorted(map(tuple, store.index().lengths.collect())) == [(2, 2), (51, 0)]
    assert sorted(map(tuple, store.index().terms.select("term", "df").collect())) == [("new", 1), ("two", 1)]
