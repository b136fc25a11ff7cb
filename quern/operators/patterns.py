"""Texts that match any of many LIKE patterns, in one pass: an automaton over their literal parts, verified by LIKE.

A pattern can match only a text that holds all its literal parts, and those without a % between them at their places. The parts of all patterns are one
Aho-Corasick automaton, which finds every part in a text at once, however many patterns there are;
the patterns whose parts a text holds go beside it as an array of their numbers, and each is then judged by LIKE itself.
So a text is one row until it is judged. Patterns without a literal part are judged on every text, of which they match
nearly all.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of an automaton, which goes to every task; more are as many passes.
MOST_PATTERNS = 100_000
#: Numbers of patterns that a batch has beside its texts, but for a text that has more by itself.
NUMBERS = 500_000


def chunks(pattern: str) -> list[list[tuple[int, str]]]:
    """What stands between the % of a LIKE pattern: runs without a wildcard and their places there, their escapes resolved."""
    out, at, run, escaped = [[]], 0, "", False
    for c in [*pattern, "%"]:
        if not escaped and c == "\\":
            escaped = True
        elif not escaped and c in "%_":
            out[-1].append((at - len(run), run))
            run, at = "", at + 1
            if c == "%":
                out.append([])
                at = 0
        else:
            run, at, escaped = run + c, at + 1, False
    return [[(a, r) for a, r in chunk if r] for chunk in out[:-1]]


def literal(pattern: str) -> str:
    """The longest run of a LIKE pattern without a wildcard."""
    return max((r for chunk in chunks(pattern) for _, r in chunk), key=len, default="")


def any_of(rows: DataFrame, key: list[str], column: str, patterns: DataFrame, fold: bool = False) -> DataFrame:
    """key, query, pattern of the rows whose column is LIKE a pattern of patterns(query, pattern); fold ignores case. Nulls match nothing."""
    spark = rows.sparkSession
    text, asked = F.col(column), F.col("pattern")
    if fold:
        text, asked = F.lower(text), F.lower(asked)
    told = patterns.where("pattern is not null").select("query", "pattern", asked.alias("asked")).distinct()
    some = rows.where(F.col(column).isNotNull()).select(*key, text.alias("__text"))
    out = None
    block: list[str] = []
    for r in told.select("asked").distinct().toLocalIterator():
        block.append(r["asked"])
        if len(block) == MOST_PATTERNS:
            found = _pass(spark, some, key, block)
            out, block = found if out is None else out.unionByName(found), []
    if block or out is None:
        found = _pass(spark, some, key, block)
        out = found if out is None else out.unionByName(found)
    return out.join(told, "asked").select(*key, "query", "pattern").distinct()


def _candidates(batches: Iterator[pa.RecordBatch], patterns: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """The rows of batches whose __text holds all parts of a pattern, each once, with the numbers of those patterns.

    The parts that stand in the longest one's chunk must also stand around it as they do there.
    """
    machine, numbers = ahocorasick.Automaton(), {}
    by_longest: dict[int, list[tuple[int, frozenset[int], list[tuple[int, str]]]]] = {}
    for number, pattern in patterns:
        parts = chunks(pattern)
        own, at, longest = max(((c, a, r) for c, chunk in enumerate(parts) for a, r in chunk), key=lambda x: len(x[2]))
        rest = frozenset(numbers.setdefault(r, len(numbers)) for chunk in parts for _, r in chunk)
        beside = [(a - at, r) for a, r in parts[own] if a != at]
        by_longest.setdefault(numbers[longest], []).append((number, rest, beside))
    for part, place in numbers.items():
        machine.add_word(part, (place, len(part)))
    if numbers:
        machine.make_automaton()
    for batch in batches:
        rows, held = [], []

        def out(rows=rows, held=held, batch=batch):
            some = batch.take(pa.array(rows, pa.int64()))
            made = pa.RecordBatch.from_arrays([*some.columns, pa.array(held, pa.list_(pa.int32()))], names=[*some.schema.names, "__patterns"])
            rows.clear()
            held.clear()
            return made

        size = 0
        for i, text in enumerate(batch.column("__text")):
            text = text.as_py()
            found: dict[int, list[int]] = {}
            for end, (place, length) in machine.iter(text) if numbers else ():
                found.setdefault(place, []).append(end + 1 - length)
            near = [
                number for place, starts in found.items() for number, rest, beside in by_longest.get(place, ())
                if rest <= found.keys() and (not beside or any(all(s + a >= 0 and text.startswith(r, s + a) for a, r in beside) for s in starts))
            ]
            if near:
                rows.append(i)
                held.append(near)
                size += len(near)
                if size >= NUMBERS:
                    yield out()
                    size = 0
        yield out()


def _pass(spark, some: DataFrame, key: list[str], block: list[str]) -> DataFrame:
    """key and asked of the texts that a block's patterns match."""
    words = spark.sparkContext.broadcast([(i, pattern) for i, pattern in enumerate(block) if literal(pattern)])
    schema = T.StructType([*some.schema.fields, T.StructField("__patterns", T.ArrayType(T.IntegerType()))])
    near = F.broadcast(spark.createDataFrame(list(enumerate(block)), "__pattern int, asked string"))  # MOST_PATTERNS rows at most
    held = some.mapInArrow(lambda batches: _candidates(batches, words.value), schema).withColumn("__pattern", F.explode("__patterns")).drop("__patterns")
    found = held.join(near, "__pattern").where(F.expr("__text LIKE asked")).select(*key, "asked")
    always = [(pattern,) for pattern in block if not literal(pattern)]
    if not always:
        return found
    every = some.crossJoin(F.broadcast(spark.createDataFrame(always, "asked string")))
    return found.unionByName(every.where(F.expr("__text LIKE asked")).select(*key, "asked"))
