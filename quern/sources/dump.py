"""SQL dumps: INSERT blocks of one table as typed rows, read by Spark's own text reader."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the dump, in its order, and its escapes.
SOURCE = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("collection", T.StringType()), ("bookNumber", T.StringType()), ("babID", T.DoubleType()), ("englishBabNumber", T.StringType()), ("arabicBabNumber", T.StringType()), ("hadithNumber", T.StringType()),
        ("ourHadithNumber", T.LongType()), ("arabicURN", T.LongType()), ("arabicBabName", T.StringType()), ("arabicText", T.StringType()), ("arabicgrade1", T.StringType()), ("englishURN", T.LongType()),
        ("englishBabName", T.StringType()), ("englishText", T.StringType()), ("englishgrade1", T.StringType()), ("last_updated", T.StringType()), ("xrefs", T.StringType()),
    )]
)

ESCAPES = {"\\": "\\", "'": "'", '"': '"', "n": "\n", "r": "\r", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a"}
FIELD = re.compile(r"[ ,]*(?:'((?:[^'\\]|\\.)*)'|([^ ,'][^,]*))", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def parse_tuple(line: str) -> list:
    """The values of a line `(...)`, a comma or semicolon after it: quoted text, NULL, decimals, integers.

    An escape that is not known keeps its backslash.
    """
    s = line.strip().rstrip(",;") if line.strip()[-1:] in ",;" else line.strip()
    if not (s.startswith("(") and s.endswith(")")):
        raise ValueError(f"not a row: {s[:80]!r}")
    out: list = []
    inner, at = s[1:-1].rstrip(" ,"), 0
    while at < len(inner):
        m = FIELD.match(inner, at)
        if not m:
            raise ValueError(f"cannot read a value at {inner[at:at + 40]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(ESCAPED.sub(lambda e: ESCAPES.get(e[1], e[0]), m[1]))
        else:
            raw = m[2].strip()
            out.append(None if raw.upper() == "NULL" else float(raw) if "." in raw else int(raw))
    return out


def opens(line: str, table: str) -> bool | None:
    """Whether a line starts the table's values; None if it is a row or says nothing."""
    s = line.lstrip()
    if s.startswith(f"INSERT INTO `{table}` VALUES"):
        return True
    return None if s.startswith("(") else False


def read_dump(spark: SparkSession, path: str, table: str, schema: T.StructType = SOURCE) -> DataFrame:
    """The table's rows. Files are split where Spark can split them; a first pass over the
    lines says what each split starts in, one row a split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def last_state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, bool | None] = {}
        for rows in batches:
            for line, file, block in rows.itertuples(index=False):
                said = opens(line, table)
                found[file, block] = said if said is not None else found.get((file, block))
        yield pd.DataFrame([(f, b, s) for (f, b), s in found.items()], columns=["file", "block", "inside"])

    states: dict[tuple[str, int], bool] = {}
    inside, before = False, None
    for file, block, said in sorted((tuple(r) for r in lines.mapInPandas(last_state, "file string, block long, inside boolean").collect()), key=lambda r: r[:2]):
        inside = inside and file == before
        states[file, block] = inside
        inside, before = said if said is not None else inside, file
    names, width = [f.name for f in schema], len(schema)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict[tuple, bool] = {}
        for rows in batches:
            out = []
            for line, file, block in rows.itertuples(index=False):
                said = opens(line, table)
                if said is not None:
                    now[file, block] = said
                elif now.get((file, block), states[file, block]):
                    values = parse_tuple(line)
                    if len(values) != width:
                        raise ValueError(f"a row has {len(values)} values, not {width}: {values[:3]!r}")
                    out.append(values)
            yield pd.DataFrame(out, columns=names, dtype=object)

    text = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return lines.mapInPandas(parse, text)
