"""SQL dumps as a Spark source and sink: spark.read.format("sqldump") and df.write.format("sqldump").

    spark.dataSource.register(DumpSource)
    spark.read.format("sqldump").option("table", "texts").option("columns", "id,title,body").schema("id long, body string").load(path)

Reading. Files are cut into splits, compressed ones stay whole. A split reads back from its start to the line
that says what statement it starts in, so no pass over the files comes first; dumps cut their statements at
the size of a packet, which bounds that. `columns` names the dump's columns in order; only those in the
schema are unescaped, and Arrow turns whole columns of a batch into their types. A row of another
number of values, or a value that is not of its type, is an error that shows it.

Writing. A task writes one file of statements of STATEMENT rows beside the target; only when all tasks are done
do the files come in by renames, and with overwrite the old ones go then. `compression` gzip writes .sql.gz.
Paths are those that pyarrow's file systems open: local ones, hdfs://, s3:// and the like.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from quern.sources.dump import ESCAPED, ESCAPES, FIELD, SOURCE, opens

SPLIT, BACK, ROWS, STATEMENT = 32 << 20, 1 << 16, 5000, 1000
ESCAPING = {ord(v): "\\" + k for k, v in ESCAPES.items()}
QUOTED = (T.StringType, T.DateType)
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def _lines(file, at: int, end: int) -> Iterator[bytes]:
    """Lines that start in [at, end) of a file at a line's start; the last one is read whole."""
    file.seek(at)
    left = b""
    while at < end:
        chunk = file.read(1 << 20)
        if not chunk:
            if left:
                yield left
            return
        *whole, left = (left + chunk).split(b"\n")
        for line in whole:
            yield line
            at += len(line) + 1
            if at >= end:
                return


def _first_line(file, start: int) -> int:
    """Where the first line begins that starts at `start` or after it."""
    at = start - 1
    while at >= 0:
        file.seek(at)
        chunk = file.read(BACK)
        if not chunk:
            return at
        if (n := chunk.find(b"\n")) >= 0:
            return at + n + 1
        at += len(chunk)
    return 0


def _inside(file, at: int, table: str) -> bool:
    """Whether the line that begins at `at` lies in the table's values: the last line before it that is no row says so."""
    tail, fresh = b"", True  # of a line that begins in the chunk before; nothing yet
    while at > 0:
        size = min(BACK, at)
        at -= size
        file.seek(at)
        tail, *lines = (file.read(size) + tail).split(b"\n")
        for line in reversed(lines[:-1] if fresh else lines):
            if (said := opens(line.decode(), table)) is not None:
                return said
        fresh = False
    return bool(opens(tail.decode(), table))


class DumpReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.columns = [c.strip() for c in options.get("columns", ",".join(schema.names)).split(",")]
        self.split = int(options.get("splitbytes", SPLIT))
        missing = [n for n in schema.names if n not in self.columns]
        if missing:
            raise ValueError(f"the dump has no columns {missing}; its columns are {self.columns}")

    def partitions(self) -> list[Split]:
        files, where = file_system(self.path)
        one = files.get_file_info(where)
        if one.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [one] if one.is_file else [f for f in files.get_file_info(pafs.FileSelector(where, recursive=True)) if f.is_file and not any(p[0] in "._" for p in f.path[len(where) :].split("/") if p)]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            step = max(f.size, 1) if f.path.endswith(".gz") else self.split
            out += [Split(f.path, a, min(f.size, a + step)) for a in range(0, f.size, step)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files = file_system(self.path)[0]
        if partition.path.endswith(".gz"):
            with files.open_input_stream(partition.path, compression=None) as raw, gzip.open(raw) as unzipped:
                yield from self._rows((line.rstrip(b"\n") for line in io.BufferedReader(unzipped, 1 << 20)), False)
            return
        with files.open_input_file(partition.path) as file:
            at = _first_line(file, partition.start) if partition.start else 0
            if at < partition.end:
                yield from self._rows(_lines(file, at, partition.end), _inside(file, at, self.table))

    def _rows(self, lines: Iterator[bytes], inside: bool) -> Iterator[pa.RecordBatch]:
        places = [self.columns.index(n) for n in self.schema.names]
        width, held = len(self.columns), []
        for raw in lines:
            line = raw.decode()
            said = opens(line, self.table)
            if said is not None:
                inside = said
            elif inside:
                held.append(self._values(line, places, width))
                if len(held) == ROWS:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _values(line: str, places: list[int], width: int) -> list[str | None]:
        """The texts of the wanted values of a line `(...)`, a comma or semicolon after it."""
        s = line.strip()
        s = s[:-1] if s[-1:] in ",;" else s
        if not (s.startswith("(") and s.endswith(")")):
            raise ValueError(f"not a row: {s[:80]!r}")
        found, inner, at = [], s[1:-1].rstrip(" ,"), 0
        while at < len(inner):
            m = FIELD.match(inner, at)
            if not m:
                raise ValueError(f"cannot read a value at {inner[at:at + 40]!r}")
            found.append(m)
            at = m.end()
        if len(found) != width:
            raise ValueError(f"a row has {len(found)} values, not {width}: {s[:80]!r}")
        out: list[str | None] = []
        for p in places:
            quoted, raw = found[p][1], (found[p][2] or "").strip()
            out.append(None if quoted is None and raw.upper() == "NULL" else raw if quoted is None else ESCAPED.sub(lambda e: ESCAPES.get(e[1], e[0]), quoted))
        return out

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        columns = []
        for i, field in enumerate(self.schema):
            texts, kind = pa.array([r[i] for r in rows], pa.string()), to_arrow_type(field.dataType)
            try:
                columns.append(texts.cast(kind))
            except pa.ArrowInvalid as e:
                raise ValueError(f"{field.name} is not a {field.dataType.simpleString()}: {e}") from e
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class DumpWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = options["path"], options["table"], schema, overwrite
        self.zipped = options.get("compression", "none") == "gzip"
        self.aside = f"_aside-{uuid.uuid4().hex}"
        wrong = [f.name for f in schema if not isinstance(f.dataType, QUOTED + PLAIN)]
        if wrong:
            raise ValueError(f"columns {wrong} are of types that a dump cannot hold")

    def _texts(self, column: pa.Array, kind: T.DataType) -> list[str]:
        if isinstance(kind, QUOTED):
            return ["NULL" if v is None else f"'{str(v).translate(ESCAPING)}'" for v in column.to_pylist()]
        values = ["NULL" if v is None else repr(v) if isinstance(v, float) else str(v) for v in column.to_pylist()]
        if isinstance(kind, (T.FloatType, T.DoubleType)) and {"nan", "inf", "-inf"} & {*values}:
            raise ValueError("a dump cannot hold a number that is not finite")
        return values

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, where = file_system(self.path)
        files.create_dir(f"{where}/{self.aside}", recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.sql{'.gz' if self.zipped else ''}"
        rows = 0
        with files.open_output_stream(f"{where}/{self.aside}/{name}", compression="gzip" if self.zipped else None) as out:
            for batch in iterator:
                lines = ["(" + ",".join(r) + ")" for r in zip(*(self._texts(c, f.dataType) for c, f in zip(batch.columns, self.schema, strict=True)), strict=True)]
                for a in range(0, len(lines), STATEMENT):
                    out.write((f"INSERT INTO `{self.table}` VALUES\n" + ",\n".join(lines[a : a + STATEMENT]) + ";\n").encode())
                rows += len(lines)
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, where = file_system(self.path)
        old = [f.path for f in files.get_file_info(pafs.FileSelector(where)) if f.is_file] if self.overwrite else []
        for m in messages:
            files.move(f"{where}/{self.aside}/{m.file}", f"{where}/{m.file}")
        for f in old:
            files.delete_file(f)
        with files.open_output_stream(f"{where}/_written.json") as out:
            out.write(json.dumps({"files": sorted(m.file for m in messages), "rows": sum(m.rows for m in messages)}).encode())
        files.delete_dir(f"{where}/{self.aside}")

    def abort(self, messages: list[Written | None]) -> None:
        files, where = file_system(self.path)
        if files.get_file_info(f"{where}/{self.aside}").type == pafs.FileType.Directory:
            files.delete_dir(f"{where}/{self.aside}")


class DumpSource(DataSource):
    """Options: path, table, columns (names in the dump's order), splitBytes; compression for writing."""

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> T.StructType:
        return SOURCE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        if "columns" not in options and set(schema.names) <= set(SOURCE.names):
            options["columns"] = ",".join(SOURCE.names)
        return DumpReader(options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DumpWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)
