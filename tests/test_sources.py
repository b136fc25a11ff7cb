"""Dumps, tables, embeddings, query sets and refreshes, round trip."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import dense
from quern.operators.search import SearchError
from quern.sources import dump, tables
from quern.streaming.refresh import refresh

SMALL = T.StructType([T.StructField("collection", T.StringType()), T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("t", T.StringType())])
DUMP = r"""-- a dump
INSERT INTO `other` VALUES
('no',1,1.0,'x');
INSERT INTO `texts` VALUES
('a',1,1.50,'it\'s \"q\" \\ \n\t\r\0\b\Z \q , ) ('),
('b',-2,-0.25,NULL),
('a',3,NULL,'');
/* end */
('not','mine');
INSERT INTO `texts` VALUES
('c',4,2.0,'ünï');
"""
ROWS = [("a", 1, 1.5, "it's \"q\" \\ \n\t\r\0\b\x1a \\q , ) ("), ("a", 3, None, ""), ("b", -2, -0.25, None), ("c", 4, 2.0, "ünï")]


def test_parse_tuple():
    assert dump.parse_tuple("  (1, 'a,b', NULL, 2.5 , null),\n") == [1, "a,b", None, 2.5, None]
    assert dump.parse_tuple("('');") == [""]
    for bad in ("INSERT", "(1", "1)"):
        with pytest.raises(ValueError):
            dump.parse_tuple(bad)


@pytest.mark.parametrize("split", [None, "60"])
def test_read_dump(spark, tmp_path, split):
    (tmp_path / "one.sql").write_text(DUMP)
    with gzip.open(tmp_path / "two.sql.gz", "wt") as f:
        f.write(DUMP.replace("`texts`", "`none`"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:  # files in pieces that start inside a block
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = dump.read_dump(spark, str(tmp_path), "texts", SMALL).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == ROWS


def test_wrong_arity(spark, tmp_path):
    (tmp_path / "x.sql").write_text("INSERT INTO `texts` VALUES\n(1,2);\n")
    with pytest.raises(Exception, match="a row has 2 values, not 4"):
        dump.read_dump(spark, str(tmp_path / "x.sql"), "texts", SMALL).collect()


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SMALL)
    assert tables.write_table(rows, f"{tmp_path}/t", "id") == 4
    assert [tuple(r) for r in tables.load_report(spark.read.parquet(f"{tmp_path}/t")).collect()] == [("a", 2), ("b", 1), ("c", 1)]
    with pytest.raises(ValueError):
        tables.write_table(rows.union(rows), f"{tmp_path}/t", "id")


def test_embeddings(spark, tmp_path):
    texts = spark.createDataFrame([(0, "N:", "abc"), (1, "", "defg"), (2, "", "")], "corpus_idx long, narrator string, text string")
    mark = tables.fingerprint(texts, F.col("text"))
    assert mark == tables.fingerprint(texts.repartition(3), F.col("text")) != tables.fingerprint(texts.withColumn("text", F.lit("x")), F.col("text"))
    vectors = dense.build(texts, lambda: lambda batch: np.array([[len(t), 1.0] for t in batch]))
    got = {r["corpus_idx"]: r["embedding"] for r in vectors.collect()}
    assert got[0] == pytest.approx([6 / 37**0.5, 1 / 37**0.5]) and got[2] == pytest.approx([0.0, 1.0])
    tables.write_embeddings(vectors, f"{tmp_path}/e", "lengths", mark)
    assert tables.read_embeddings(spark, f"{tmp_path}/e", mark).count() == 3
    with pytest.raises(RuntimeError):
        tables.read_embeddings(spark, f"{tmp_path}/e", "another")
    with pytest.raises(SearchError):
        tables.read_embeddings(spark, f"{tmp_path}/none")


def test_query_set(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"_status": "x", "queries": [{"query": "a", "mode_hint": "term", "relevant": [{"collection": "c", "hadith_number": "1"}]}, {"query": "b", "relevant": []}]}, indent=1))
    queries, relevant = tables.read_query_set(spark, str(tmp_path / "q.json"))
    assert [tuple(r) for r in queries.orderBy("query_id").collect()] == [(0, "a", "term"), (1, "b", "concept")]
    assert [tuple(r) for r in relevant.collect()] == [(0, "c", "1")]
    tables.write_report(relevant, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 1


def test_refresh(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SMALL)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    run = lambda: refresh(spark, f"{tmp_path}/in", SMALL, f"{tmp_path}/state", lambda new, batch: seen.append(new.count()))
    assert run() == 1 and run() == 0
    rows.limit(2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 1 and seen == [4, 2]
