"""Near-duplicate vectors by E8 lattice hashing, with every found pair verified by cosine.

A table projects unit vectors at random onto BLOCKS blocks of eight dimensions, shifts them
at random and decodes each block to the nearest point of the lattice E8; the points name a
cell. A vector is at home in its own cell and also asks the PROBES neighbouring cells that
it is nearest to, each one step along one of E8's 240 shortest vectors. Two vectors meet
where one is at home in a cell that the other is at home in or asks. In a cell all pairs
that meet are compared by cosine in double precision, as products of matrices.

Equal vectors are one class before anything is hashed, so a vector that a third of all rows
hold is hashed once. Cells are counted first; a large one is dealt into parts of CELL vectors
at most, and each pair of parts is a task's piece of its own, so no cell is gathered whole and
none is cut. Pairs never become rows: a piece counts the links of its vectors and adds a
spanning forest of them for the components. A pair that meets in several tables or cells
counts in the first only, which a piece knows by hashing the few linked vectors again.

At a cosine of 0.95 exactly, two vectors of 64 dimensions meet in one table with a chance of
0.6, in one of TABLES with 0.999; closer ones with more. Pairs below the threshold are never linked.

Nulls: vectors that are null, empty, zero or hold null or non-finite components link with
nothing. Vectors of different lengths never link. A null vec_id is an id like any other that
is the greatest; rows of one id are linked like any others. Repeated rows each give a row. No
rows give none.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_long, drop, join_hot, keep, lean
from quern.llm.graph import components

COSINE = 0.95
TABLES = 8
#: Blocks of eight dimensions that name a cell together.
BLOCKS = 3
#: Neighbouring cells that a vector asks in each table.
PROBES = 2
#: Side of the lattice in units of a unit vector's mean coordinate.
WIDTH = 3.6
#: Vectors of one part of a cell.
CELL = 1000
#: What a piece of a cell is known by; vectors of pieces that are compared together, rows and pairs at a time.
PIECE = ["table", "dims", "cell", "a", "b"]
SMALL, ROWS, PAIRS = 64, 8192, 50_000


@functools.cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or eight halves with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of an even sum."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight: the nearer of the even integers and the even integers moved by a half."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@functools.lru_cache(maxsize=256)
def _table(table: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table's projection, shift, and odd multipliers that mix lattice points into 64 bits."""
    rng = np.random.default_rng([table, dims])
    wide = rng.standard_normal((dims, max(dims, 8 * BLOCKS)))
    turned = np.linalg.qr(wide)[0] if dims >= 8 * BLOCKS else wide / np.sqrt(dims)
    return turned[:, : 8 * BLOCKS] * (np.sqrt(dims) / WIDTH), rng.uniform(size=8 * BLOCKS), rng.integers(0, 1 << 63, 8 * BLOCKS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def cells(units: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector, the cell where it is at home, and an array [vector, PROBES] of those it asks."""
    turn, shift, odd = _table(table, units.shape[1])
    y = units @ turn + shift
    points, gains, steps = [], [], []
    for k in range(BLOCKS):
        block = y[:, 8 * k : 8 * k + 8]
        point = decode(block)
        gain = (block - point) @ shortest().T
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        points.append(point)
        gains.append(np.take_along_axis(gain, best, 1))
        steps.append(shortest()[best])
    with np.errstate(over="ignore"):
        weigh = lambda x, k: ((2 * x).astype(np.int64).astype(np.uint64) * odd[8 * k : 8 * k + 8]).sum(-1, dtype=np.uint64)
        name = odd[-1] + sum(weigh(p, k) for k, p in enumerate(points))
        moved = np.concatenate([name[:, None] + weigh(s, k) for k, s in enumerate(steps)], 1)
        order = np.argsort(-np.concatenate(gains, 1), axis=1, kind="stable")[:, :PROBES]
        asked = np.take_along_axis(moved, order, 1)
        return _mixed(name), _mixed(asked)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, so sums of points that differ stay different names."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(column: pa.Array):
    lengths = pc.list_value_length(column).to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, _matrix(column.take(pa.array(rows)))


def _name(batches):
    """table, cell and whether at home there, of each class; without its vector."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column("node").to_numpy()
        for rows, vectors in _by_length(batch.column("value")):
            units = unit(vectors)
            for t in range(TABLES):
                home, asked = cells(units, t)
                every = np.concatenate([home[:, None], asked], 1)
                at_home = np.zeros(every.shape, bool)
                at_home[:, 0] = True
                numbers = [np.repeat(nodes[rows], 1 + PROBES), np.full(every.size, t, np.int32), np.full(every.size, vectors.shape[1], np.int32), every.ravel(), at_home.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], names=["node", "table", "dims", "cell", "home"])


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left = links.any(1)
    edges = []
    for start in range(len(links)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(links[i] & left)
            left[new] = False
            edges += [(i, j) for j in new.tolist()]
            queue += new.tolist()
    return edges


def first_meeting(units: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether the pairs (i, j), which meet in this cell, meet in no earlier table and in no lesser cell of this one."""
    new = np.ones(len(i), bool)
    for t in range(table + 1):
        home, asked = cells(units, t)
        same = home[i] == home[j]
        j_asks, i_asks = (asked[j] == home[i][:, None]).any(1), (asked[i] == home[j][:, None]).any(1)
        if t < table:
            new &= ~(same | j_asks | i_asks)
        else:
            new &= same | ~((j_asks & (home[i] < cell)) | (i_asks & (home[j] < cell)))
    return new


def _compare(cosine: float):
    """Link counts and forest edges of each piece, of rows sorted by piece; a piece has two parts at most."""

    def piece(key, rows):
        nodes, sizes, home, part, vectors = rows
        table, _, cell, a, b = key
        if len(nodes) < 2 or not home.any():
            return
        units = unit(vectors)
        left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
        links = units[left] @ units[right].T >= cosine
        links &= home[left, None] | home[None, right]
        i, j = np.nonzero(np.triu(links, 1) if a == b else links)
        i, j = left[i], right[j]
        some, at = np.unique(np.r_[i, j], return_inverse=True)
        new = first_meeting(units[some], at[: len(i)], at[len(i) :], table, cell)
        some, at = np.unique(np.r_[i[new], j[new]], return_inverse=True)
        i, j = at[: len(at) // 2], at[len(at) // 2 :]
        if not len(i):
            return
        counts = np.zeros(len(some), np.int64)
        np.add.at(counts, i, sizes[some][j])
        np.add.at(counts, j, sizes[some][i])
        links = np.zeros((len(some), len(some)), bool)
        links[i, j] = links[j, i] = True
        yield nodes[some], counts, np.array(forest(links), np.int64).reshape(-1, 2)

    def run(batches):
        for table, at in whole_pieces(batches):
            nodes, sizes, home, part = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "home", "part"))
            ends = np.r_[at[1:], table.num_rows]
            for k in near_pieces(table, at, ends, home, cosine).tolist():
                x, y = int(at[k]), int(ends[k])
                key = tuple(table.column(c)[x].as_py() for c in PIECE)
                yield from _rows(piece(key, (nodes[x:y], sizes[x:y], home[x:y], part[x:y], _matrix(table.column("value").slice(x, y - x)))))

    return run


def whole_pieces(batches):
    """Tables of sorted rows that begin and end with a piece, and where their pieces start."""
    left: list = []

    def given(table, end):
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in PIECE], 1)
        at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        stop = table.num_rows if end else int(at[-1])
        if stop:
            yield table.slice(0, stop), at if end else at[:-1]
        left[:] = [] if end else [table.slice(stop)]

    for batch in batches:
        if batch.num_rows:
            left.append(batch)
            if sum(b.num_rows for b in left) >= ROWS:
                yield from given(pa.Table.from_batches(left).combine_chunks().to_batches()[0], False)
    if left:
        yield from given(pa.Table.from_batches(left).combine_chunks().to_batches()[0], True)


def near_pieces(table, at: np.ndarray, ends: np.ndarray, home: np.ndarray, cosine: float) -> np.ndarray:
    """Pieces that may have a link: the large ones, and of the small ones those with a pair that is near enough, all compared together."""
    sizes = ends - at
    large = sizes > SMALL
    lengths = pc.list_value_length(table.column("value")).to_numpy()
    if (lengths != lengths[0]).any():
        return np.flatnonzero(sizes > 1)
    units = unit(_matrix(table.column("value")))
    of = np.repeat(np.arange(len(at)), sizes)
    rows = np.arange(table.num_rows)
    after = np.where(large[of], 0, ends[of] - 1 - rows)  # partners of a row: the rest of its piece
    before = np.r_[0, np.cumsum(after)]
    near = large.copy()
    a = 0
    while a < len(rows):  # rows with so many pairs together
        b = max(a + 1, int(np.searchsorted(before, before[a] + PAIRS, "right")) - 1)
        x = np.repeat(rows[a:b], after[a:b])
        y = x + 1 + np.arange(len(x)) - np.repeat(before[a:b] - before[a], after[a:b])
        some = home[x] | home[y]
        x, y = x[some], y[some]
        near[of[x[np.einsum("ij,ij->i", units[x], units[y]) >= cosine - 1e-9]]] = True
        a = b
    return np.flatnonzero(near)


def _rows(found):
    """A row a linked vector, with its count and an edge of the forest; there are fewer edges than vectors."""
    for nodes, counts, edges in found:
        a, b = nodes.copy(), nodes.copy()
        a[: len(edges)], b[: len(edges)] = nodes[edges[:, 0]], nodes[edges[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes, counts, a, b)], names=["node", "links", "a", "b"])


def near_groups(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Each vector's number of links, the least id reachable by links, and whether it is that one."""
    value = vectors[vector_col].cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select(as_long(vectors, id_col).alias("vec_id"), F.when(good, vectors[vector_col]).alias("value"))
    classes = rows.where("value is not null").groupBy("value").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "lattice-classes")
    hashed = classes.select("node", "value").mapInArrow(lean(_name), "node long, table int, dims int, cell long, home boolean")
    cell = ["table", "dims", "cell"]
    named = keep(hashed, "lattice-cells")
    # a vector is in one cell of a table once: at home, or asking; cells without two of them or without a home are left
    counted = named.groupBy(*cell).agg(F.count(F.lit(1)).alias("held"), F.max("home").alias("any")).where("held > 1 and any")
    counted = keep(counted.withColumn("parts", F.ceil(F.col("held") / CELL).cast("int")).drop("any"), "lattice-counts")
    placed = join_hot(named, counted, cell, "held", named.count())
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("node", *cell, "home", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    met = placed.join(classes.select("node", "n", "value"), "node").repartition(*PIECE).sortWithinPartitions(*PIECE)
    found = keep(met.mapInArrow(lean(_compare(cosine)), "node long, links long, a long, b long"), "lattice-links")
    drop(named, counted)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = keep(components(found.select("a", "b")), "lattice-reach")
    own = classes.select("node", "value", "least", "n").join(links, "node", "left").join(reach, "node", "left")
    own = keep(own.select("value", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "lattice-own")
    heads = keep(own.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "lattice-heads")
    of = join_hot(own, heads, ["component"], "size", own.count())
    of = keep(of.select("value", "n", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id"), "lattice-result")
    drop(classes, found, reach, own, heads)
    linked = join_hot(rows.where("value is not null"), of, ["value"], "n", rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("value is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive rows as (
  select vec_id, embedding::double[] as v, list_aggregate(list_transform(embedding::double[], lambda x: x * x), 'sum') as square,
         coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0, false) as finite from embeddings
), good as (
  select vec_id, v, sqrt(square) as norm from rows where finite and square > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a as vec_id, min(b) as component_id from reach group by a
)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join least c on e.vec_id = c.vec_id
"""
