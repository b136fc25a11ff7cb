"""Document fingerprints by order MinHash.

Each k-mer of a text is numbered by its occurrence, so repeated k-mers are different
elements. A hash deals the elements into slots and orders them there; each slot takes
its few least elements, puts them back in text order, and hashes that tuple of k-mers.
A fingerprint is the row of these hashes. Two texts agree in a slot if the same k-mers
were chosen in the same order, which moves with the edit distance where plain MinHash
sees only the set. The likeness of two fingerprints is the share of equal slots among
those that either of them fills.

Neighbours by id are found without a global window: ids alone are sorted into ranges,
each text goes to its range once, and the first texts of a range also go to the range
before it. Each range is one task. Ranges are cut by ids, so rows that share an id are in one.

Nulls: a null text is empty, and an empty text has an empty fingerprint, fully like
another empty one. Rows with a null id stand before all others; rows that share an id
stand in the order of a hash of their texts. A lone row is its own neighbour.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytesets as B
from quern.llm.common import as_long, lean, text_column

K, SLOTS, TAKEN = 8, 128, 2
#: Rows of a range, and ranges at most: the driver holds a number for each, and each is a task.
ROWS_A_RANGE, MOST_RANGES = 4096, 200_000
_NTH = np.uint64(0xD1B54A32D192ED03)


def sketch(text: str, k: int = K, slots: int = SLOTS, taken: int = TAKEN) -> np.ndarray:
    """A 32-bit hash for each slot; 0 where a slot has no element. slots is a power of two."""
    out = np.zeros(slots, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return out
    sums = B.prefix_sums(points)
    if n <= k:
        kmers = B.span_hash(sums, np.array([0]), np.array([n]))
    else:
        kmers = B.mix((sums[k:] - sums[:-k]) * B.powers(n - k + 1, "down"))
    order = np.argsort(kmers, kind="stable")
    sorted_kmers = kmers[order]
    at = np.arange(len(kmers))
    first = np.where(np.r_[True, sorted_kmers[1:] != sorted_kmers[:-1]], at, 0)
    nth = (at - np.maximum.accumulate(first)).astype(np.uint64)
    keys = B.mix(sorted_kmers + nth * _NTH)
    rank = np.argsort(keys)
    keys = keys[rank]
    shift = np.uint64(64 - slots.bit_length() + 1)
    edges = np.searchsorted(keys, np.arange(slots, dtype=np.uint64) << shift)
    ends = np.r_[edges[1:], len(keys)]
    filled = np.flatnonzero(ends > edges)
    picked = edges[filled][:, None] + np.arange(taken)
    # the text positions of a slot's least elements, in text order; missing ones stand last
    missing = picked >= ends[filled][:, None]
    places = np.where(missing, n, order[rank[np.minimum(picked, len(keys) - 1)]])
    places.sort(axis=1)
    value = np.full(len(filled), np.uint64(1))
    for j in range(taken):
        one = np.where(places[:, j] < n, kmers[np.minimum(places[:, j], len(kmers) - 1)], np.uint64(0))
        value = B.mix(value * B.BASE + one)
    out[filled] = (value >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal slots among filled ones; 1 for two empty fingerprints."""
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return float((a == b)[filled].sum() / n) if n else 1.0


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex() if fingerprint.any() else ""


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, slots: int = SLOTS, taken: int = TAKEN) -> DataFrame:
    """doc_id and fingerprint (hexadecimal, empty for an empty text) of every row."""

    def run(batches):
        for batch in batches:
            found = [as_text(sketch(t, k, slots, taken)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(as_long(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text")).mapInArrow(lean(run), "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """text with its last half replaced by as much of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and its likeness to that and to the next row by id."""
    slim = docs.select(as_long(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    ids = slim.select("doc_id")
    ranges = int(min(MOST_RANGES, max(8, ids.count() // ROWS_A_RANGE)))
    dealt = ids.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).select("doc_id", F.spark_partition_id().alias("range"))
    heads = dealt.groupBy("range").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("range").collect()
    has_null = any(r["nulls"] for r in heads)
    starts = np.array([r["least"] for r in heads if r["least"] is not None], np.int64)  # at most MOST_RANGES
    last = max(0, len(starts) - 1)

    def deal(batches):
        for batch in batches:
            key = batch.column(0)
            absent = np.array(key.is_null())
            value = key.fill_null(0).to_numpy(zero_copy_only=False)
            where = np.maximum(np.searchsorted(starts, value, "right") - 1, 0) if len(starts) else np.zeros(len(value), np.int64)
            where[absent] = 0
            head = ~absent & (starts[where] == value) if len(starts) else np.zeros(len(value), bool)
            if has_null:
                head = np.where(where == 0, absent, head)
            again = np.flatnonzero(head)
            rows = np.r_[np.arange(len(value)), again]
            to = np.r_[where, np.where(where[again] == 0, last, where[again] - 1)]
            ahead = np.r_[np.zeros(len(value), bool), np.ones(len(again), bool)]
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(ahead), *picked.columns], names=["range", "ahead", "doc_id", "text"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches):
        held = None  # the range, id, text and fingerprint of the row before
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out: list[tuple] = []
            for where, ahead, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = held is not None and held[0] == where
                if ahead and not same:
                    continue
                own = sketch(text)
                if same:
                    _, before, old, old_print = held
                    new = edited_text(old, text)
                    new_print = sketch(new)
                    digest = hashlib.sha256(new.encode()).hexdigest()
                    out.append((before, len(old), digest, as_text(old_print), as_text(new_print), likeness(old_print, new_print), likeness(old_print, own)))
                held = None if ahead else (where, key, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    rows = slim.mapInArrow(lean(deal), "range long, ahead boolean, doc_id long, text string").repartitionById(ranges, F.col("range").cast("int"))
    return rows.sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(lean(compare), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
