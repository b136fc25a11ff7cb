"""What the operators share: written tables, checked broadcasts, column handling."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import shutil
import tempfile
import threading
import uuid
import weakref

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a broadcast side has at most; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset on a local master one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        where = f"file://{where}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Spark's setting by which a query's shuffle files go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that keep() has written and nothing has deleted yet, with what opens their file system.
_KEPT: dict[str, object] = {}
#: The thread that wrote each of them.
_WRITERS: dict[str, int] = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and lost executors cost nothing.

    What its plan shuffled goes from the executors' disks once it is written, not when the driver next collects garbage.
    The table goes when drop() or drop_kept() is called for it, or with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    if not _KEPT:
        atexit.unregister(_delete_all)
        atexit.register(_delete_all)
    _KEPT[path] = spark.sparkContext
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out], _WRITERS[path] = path, threading.get_ident()
    return out


def _delete(path: str) -> None:
    context = _KEPT.pop(path)
    _WRITERS.pop(path, None)
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration() if context._jsc is None else context._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all() -> None:
    """At the driver's end; its JVM outlives the session."""
    for path in list(_KEPT):
        try:
            _delete(path)
        except (Py4JError, OSError, AttributeError):  # the JVM has gone, or the file system has
            return


def drop(*tables: DataFrame) -> None:
    """Delete tables that keep() gave and that no plan reads any more."""
    for table in tables:
        _delete(_PATHS.pop(table))


def kept_paths() -> set[str]:
    """Where the tables are that keep() has written and nothing has deleted."""
    return set(_KEPT)


def drop_but(paths: set[str], *tables: DataFrame) -> None:
    """Delete what this thread has written by keep(), but for what is at these paths and for these tables."""
    for path in set(_KEPT) - paths - {_PATHS[t] for t in tables}:
        if _WRITERS.get(path) == threading.get_ident():
            _delete(path)


def drop_kept(spark: SparkSession) -> None:
    """Delete every table that keep() has written in this application; results that still read them become unusable."""
    for path in [p for p, context in _KEPT.items() if context is spark.sparkContext]:
        _delete(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes (as JSON), else as it is."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if found[0] <= rows and (found[1] or 0) <= size else df


#: Rows from which a key is hot, unless a millionth of all rows is more: so at most a million keys are.
HOT_ROWS = 1000


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], size: str, rows: int) -> DataFrame:
    """many joined with one, which has a row a key and in `size` how many rows of many it meets.

    The rows of hot keys stay where they are and meet a broadcast of those keys, of which
    there are at most a million; all others are joined by a shuffle that has no hot key.
    many is read twice and should be kept or cheap, and one is kept.
    """
    least = max(HOT_ROWS, rows // BROADCAST_ROWS)
    if not one.where(F.col(size) >= least).limit(1).count():
        return many.join(one, keys)
    hot = F.broadcast(one.where(F.col(size) >= least))
    rest = many.join(hot.select(*keys), keys, "left_anti").join(one.where(F.col(size) < least), keys)
    return many.join(hot, keys).unionByName(rest)


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def as_long(df: DataFrame, name: str = "doc_id") -> Column:
    return df[name].cast(T.LongType())


def word_count(text: Column) -> Column:
    r"""Runs of characters other than blanks, `[^\x20\x09-\x0D]+`."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def release() -> None:
    """Give a worker's freed memory back to the system; Spark keeps workers for later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f):
    """An Arrow function, of batches or of a group's table, after which memory is released."""

    @functools.wraps(f)
    def over_batches(batches):
        try:
            yield from f(batches)
        finally:
            release()

    @functools.wraps(f)
    def over_group(table):
        try:
            return f(table)
        finally:
            release()

    return over_batches if inspect.isgeneratorfunction(f) else over_group
