"""Exact dense top-k for any number of queries: cells around centers, skipped by distance bounds.

Vectors lie in cells around centers and, in a cell, in packs by their distance to the center;
a pack is one row, its ids and vectors the bytes of arrays. For a vector x that is between low
and high away from its center c, and a query q,

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2,   |q - x| >= max(|q - c| - high, low - |q - c|, 0),

so a cell or a pack whose bound is below a query's k-th best so far holds none of its answer.

Each query first visits the cells of its nearest centers until they hold k vectors, which gives
its threshold, and then every cell whose bound reaches it. Queries travel in blocks of QUERIES to the
cells that they visit; a block and a pack meet as one matrix product, and a task keeps k rows a
query at a time. Neither side is ever gathered: a cell is dealt into units of UNIT packs, queries
into groups of GROUP, and a unit meets a group in one task. The driver has centers and cell sizes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.kept import kept

#: Vectors that centers are fitted on, the least by a hash of their ids; centers, and rounds of fitting.
SAMPLE, CELLS, ROUNDS = 20_000, 256, 8
#: Vectors in a pack, packs in a unit; queries in a block and in a group.
PACK, UNIT, QUERIES, GROUP = 4096, 64, 256, 16_384
#: Rows that a task holds before it cuts them to k a query.
HELD = 500_000
#: Scores are rounded to six places.
SLACK = 2e-6
PACKS = "cell int, n int, low double, high double, norm double, ids binary, vectors binary"


@dataclass
class Index:
    """cells(cell, center) and packs(cell, n, low, high, norm, ids, vectors)."""

    cells: DataFrame
    packs: DataFrame

    def write(self, path: str) -> None:
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        self.packs.write.mode("overwrite").parquet(f"{path}/packs")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("cells", "packs")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2 * x @ centers.T
    return np.sqrt(np.maximum(square, 0))


def fit(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Centers of a sample: some rounds of k-means from evenly spaced rows."""
    centers = sample[np.linspace(0, len(sample) - 1, max(1, min(cells, len(sample) // 16))).astype(int)]
    for _ in range(ROUNDS):
        near = _distances(sample, centers).argmin(1)
        sizes = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return centers


def build(vectors: DataFrame, pack: int = PACK, cells: int = CELLS) -> Index:
    """The index of vectors (corpus_idx, embedding) of one length; null ones are left out.

    A cell is laid out by ranges of (cell, distance, id), so one that holds a third of all rows, or of
    equal vectors, is many tasks' and many packs.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null").select(F.col("corpus_idx").cast("long").alias("corpus_idx"), F.col("embedding").cast("array<float>").alias("embedding"))
    sample = rows.orderBy(F.xxhash64("corpus_idx"), "corpus_idx").limit(SAMPLE).collect()
    if not sample:
        return Index(spark.createDataFrame([], "cell int, center array<double>"), spark.createDataFrame([], PACKS))
    centers = fit(np.array([r["embedding"] for r in sample], np.float64), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _distances(_matrix(batch.column("embedding")), centers)
            cell = away.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), *batch.columns], names=["cell", "distance", "corpus_idx", "embedding"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row(table: pa.Table) -> pa.RecordBatch:
            x = _matrix(table.column("embedding").combine_chunks())
            away = table.column("distance").to_numpy()
            values = [table.column("cell")[0].as_py(), len(x), float(away[0]) - SLACK, float(away[-1]) + SLACK, float(np.sqrt((x * x).sum(1).max())), table.column("corpus_idx").to_numpy().astype("<i8").tobytes(), x.astype("<f4").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in PACKS.split(", ")])

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            cell = table.column("cell").to_numpy()
            at = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            held.clear()
            for a, b in zip(at, at[1:], strict=False):
                for c in range(a, b, pack):
                    part = table.slice(c, min(pack, b - c))
                    if last or c + pack < b or b < len(cell):
                        yield row(part)
                    else:
                        held.extend(part.to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(h.num_rows for h in held) > pack:
                    yield from full(False)
        if held:
            yield from full(True)

    placed = rows.mapInArrow(place, "cell int, distance double, corpus_idx long, embedding array<float>")
    order = ["cell", "distance", "corpus_idx"]
    packs = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, PACKS)
    return Index(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>"), packs)


def k_best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each id's k rows of the greatest score, the lower row first of equal ones."""
    order = np.lexsort((rows, -scores, ids))
    starts = np.r_[0, np.flatnonzero(np.diff(ids[order])) + 1]
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


def top(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, corpus_idx, score (dot product, six places), rank of each query's k best rows; ties by corpus_idx. queries(query_id, query)."""
    spark = queries.sparkSession
    cells = index.cells.orderBy("cell").collect()  # CELLS rows at most
    sizes = {r["cell"]: r for r in index.packs.groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("packs"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")).collect()}
    out = "query_id long, corpus_idx long, score double"
    if not sizes:
        return spark.createDataFrame([], f"{out}, rank int")
    known = [r for r in cells if r["cell"] in sizes]
    names = np.array([r["cell"] for r in known], np.int32)
    centers = np.array([r["center"] for r in known], np.float64)
    n, packs, low, high, norm = (np.array([sizes[c][x] for c in names.tolist()]) for x in ("n", "packs", "low", "high", "norm"))
    units = np.ceil(packs / UNIT).astype(int)
    asked = queries.where("query is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    groups = asked.count() // GROUP + 1

    def first(away: np.ndarray) -> np.ndarray:
        """Of each query, the nearest cells that hold k vectors together."""
        order = away.argsort(1, kind="stable")
        before = np.cumsum(n[order], 1) - n[order]
        seen = np.zeros(away.shape, bool)
        np.put_along_axis(seen, order, before < k, 1)
        return seen

    def visits(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("query"))
                away = _distances(q, centers)
                if not again:
                    go = first(away)
                else:
                    least = batch.column("least").to_numpy(zero_copy_only=False)
                    gap = np.maximum(np.maximum(away - high, low - away), 0)
                    bound = ((q * q).sum(1)[:, None] + norm**2 - gap * gap) / 2
                    go = ~(bound < least[:, None] - SLACK)
                row, cell = np.nonzero(go)
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(names[cell]), pa.array(units[cell].astype(np.int32)), *some.columns], names=["cell", "units", *some.schema.names])

        return run

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell, unit and group as rows of at most QUERIES of them."""
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "unit", "group")], 1)
            at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            found = []
            for a, b in zip(at, at[1:], strict=False):
                for c in range(a, b, QUERIES):
                    part = batch.slice(c, min(QUERIES, b - c))
                    found.append((*key[a].tolist(), part.column("query_id").to_numpy().astype("<i8").tobytes(), _matrix(part.column("query")).astype("<f8").tobytes(), part.column("least").to_numpy(zero_copy_only=False).astype("<f8").tobytes()))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["cell", "unit", "group", "q_ids", "q_vectors", "q_least"])

    where = {int(c): centers[i] for i, c in enumerate(names)}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut() -> pa.RecordBatch:
            ids, rows, scores = (np.concatenate([h[i] for h in held]) for i in range(3))
            some = k_best(ids, rows, scores, k)
            held[:] = [(ids[some], rows[some], scores[some])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["query_id", "corpus_idx", "score"])

        for batch in batches:
            for cell, near, far, size, ids, vectors, q_ids, q_vectors, q_least in zip(*(batch.column(c).to_pylist() for c in ("cell", "low", "high", "norm", "ids", "vectors", "q_ids", "q_vectors", "q_least")), strict=True):
                rows, asks, least = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8"), np.frombuffer(q_least, "<f8")
                x, q = np.frombuffer(vectors, "<f4").reshape(len(rows), -1).astype(np.float64), np.frombuffer(q_vectors, "<f8").reshape(len(asks), -1)
                away = np.sqrt(((q - where[cell]) ** 2).sum(1))
                gap = np.maximum(np.maximum(away - far, near - away), 0)
                go = np.flatnonzero(~(((q * q).sum(1) + size * size - gap * gap) / 2 < least - SLACK))
                if not len(go):
                    continue
                scores = np.round(q[go] @ x.T, 6)
                kth = -np.partition(-scores, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
                a, b = np.nonzero(scores >= np.fmax(kth, least[go] - SLACK)[:, None])
                found = asks[go][a], rows[b], scores[a, b]
                some = k_best(*found, k)
                held.append(tuple(f[some] for f in found))
                if sum(len(h[0]) for h in held) >= HELD:
                    batch_of = cut()
                    if batch_of.num_rows >= HELD // 2:
                        yield batch_of
                        held.clear()
        if held:
            yield cut()

    number = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    unit = F.explode(F.sequence(F.lit(0), F.col("units") - 1))
    units_of = F.element_at(F.create_map(*(F.lit(int(x)) for pair in zip(names, units, strict=True) for x in pair)), F.col("cell"))
    dealt = index.packs.withColumn("unit", F.pmod(F.xxhash64("ids"), units_of).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["cell", "unit", "group"]

    def visited(rows: DataFrame, again: bool) -> DataFrame:
        sent = rows.mapInArrow(visits(again), "cell int, units int, query_id long, query array<double>, least double")
        sent = sent.select("cell", unit.alias("unit"), number.cast("int").alias("group"), "query_id", "query", "least")
        block = sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(blocks, "cell int, unit int, group int, q_ids binary, q_vectors binary, q_least binary")
        return dealt.join(block, keys).mapInArrow(products, out)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_idx"))
    near = kept(visited(asked.withColumn("least", F.lit(float("nan"))), False).withColumn("rank", rank).where(F.col("rank") <= k), "nearest")
    least = asked.join(near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "query_id", "left").na.fill(float("-inf"), ["least"])
    return visited(least.select("query_id", "query", "least"), True).withColumn("rank", rank).where(F.col("rank") <= k)
