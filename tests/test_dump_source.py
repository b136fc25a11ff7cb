"""The dump source and sink: splits, pruning, types, errors, whole or no files."""

import gzip
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.sources import tables
from quern.sources.dump_source import DumpSource
from tests.test_sources import DUMP, ROWS

COLUMNS = "collection,id,x,t"


@pytest.fixture()
def reader(spark):
    spark.dataSource.register(DumpSource)
    return lambda path, schema="collection string, id long, x double, t string", **more: spark.read.format("sqldump").options(table="texts", columns=COLUMNS, **more).schema(schema).load(str(path))


@pytest.mark.parametrize("split", [7, 33, 60, 1000])
def test_any_split_gives_the_rows(reader, tmp_path, split):
    (tmp_path / "one.sql").write_text(DUMP)
    (tmp_path / "_skipped").write_text(DUMP)
    with gzip.open(tmp_path / "two.sql.gz", "wt") as f:
        f.write(DUMP.replace("'a'", "'zip'"))
    got = [tuple(r) for r in reader(tmp_path, splitBytes=split).collect()]
    zipped = [("zip" if r[0] == "a" else r[0], *r[1:]) for r in ROWS]
    assert sorted(got, key=str) == sorted(ROWS + zipped, key=str)
    assert reader(tmp_path, splitBytes=split).rdd.getNumPartitions() >= 1 + len(DUMP.encode()) // split


def test_only_the_columns_of_the_schema_in_their_order(reader, tmp_path):
    (tmp_path / "one.sql").write_text(DUMP)
    assert sorted(tuple(r) for r in reader(tmp_path / "one.sql", "id int, collection string").collect()) == sorted((r[1], r[0]) for r in ROWS)
    assert sorted(r[0] for r in reader(tmp_path, "id string").collect()) == sorted(str(r[1]) for r in ROWS)
    assert reader(tmp_path).where("id = 4").select("t").collect()[0][0] == "ünï"


def test_long_rows_across_many_chunks(reader, tmp_path):
    text = "x" * 300_000
    (tmp_path / "one.sql").write_text("INSERT INTO `texts` VALUES\n" + ",\n".join(f"('a',{i},1.0,'{text if i % 3 == 0 else i}')" for i in range(12)) + ";\n")
    got = reader(tmp_path, splitBytes=100_000).select("id", F.length("t").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(i, 300_000 if i % 3 == 0 else len(str(i))) for i in range(12)]


@pytest.mark.parametrize("body, said", [("(1,2);", "values, not 4"), ("('a','x',1.0,'t');", "not a bigint"), ("('a',1,1.0,'t'", "not a row"), ("('a,1,1.0,t);", "cannot read a value")])
def test_broken_rows(reader, tmp_path, body, said):
    (tmp_path / "x.sql").write_text(f"INSERT INTO `texts` VALUES\n{body}\n")
    with pytest.raises(PySparkException, match=said):
        reader(tmp_path).collect()


def test_missing_column_and_path(reader, tmp_path):
    with pytest.raises(PySparkException, match="no columns"):
        reader(tmp_path, "nothing string").collect()
    with pytest.raises(PySparkException, match="FileNotFound"):
        reader(tmp_path / "absent").collect()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, reader, tmp_path, compression):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([(*r[:3], r[3]) for r in ROWS] + [(None, None, 1e300, "\\n'\\'")], "collection string, id long, x double, t string")
    write = frame.repartition(3).write.format("sqldump").options(table="texts", compression=compression)
    for _ in range(2):  # the second write replaces the first
        write.mode("overwrite").save(path)
    assert sorted(map(str, map(tuple, reader(path).collect()))) == sorted(map(str, map(tuple, frame.collect())))
    write.mode("append").save(path)
    assert reader(path).count() == 2 * frame.count()
    assert json.load(open(f"{path}/_written.json"))["rows"] == frame.count()
    assert not [n for n in os.listdir(path) if n.startswith("_aside")]


def test_a_failed_write_leaves_the_old_files(spark, reader, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame(ROWS, "collection string, id long, x double, t string")
    good.write.format("sqldump").option("table", "texts").mode("overwrite").save(path)
    with pytest.raises(Exception, match="not finite"):
        good.withColumn("x", F.lit(float("nan"))).write.format("sqldump").option("table", "texts").mode("overwrite").save(path)
    assert sorted(map(str, map(tuple, reader(path).collect()))) == sorted(map(str, ROWS))
    with pytest.raises(Exception, match="cannot hold"):
        good.withColumn("x", F.array("x")).write.format("sqldump").option("table", "texts").mode("append").save(path)


def test_a_table_is_computed_once_and_replaced_whole(spark, tmp_path):
    seen, path = spark.sparkContext.accumulator(0), str(tmp_path / "table")

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).select("id", (F.col("id") % 3).alias("collection")).mapInArrow(counted, "id long, collection long")
    assert tables.write_table(rows, path, "id") == 100 and seen.value == 100
    for bad in (spark.createDataFrame([(1, 1), (1, 2)], "id long, collection long"), spark.createDataFrame([(None, 1)], "id long, collection long")):
        with pytest.raises(ValueError, match="not unique or is null"):
            tables.write_table(bad, path, "id")
    assert spark.read.parquet(path).count() == 100 and sorted(os.listdir(tmp_path)) == ["table"]
    assert tables.write_table(rows.where("id < 5"), path, "id") == 5 and spark.read.parquet(path).count() == 5
