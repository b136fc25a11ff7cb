"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's set is its distinct shingles. Two sets whose Jaccard similarity reaches t
share a token among the first n - ceil(t * n) + 1 of each, whatever total order the
tokens are put in. Three independent orders give three such filters, and a pair is a
candidate only if it passes all of them. In each order tokens that many sets hold
come last (counted over the whole corpus, a set once for each part of PART bytes that has
it, tokens that agree in all but SHIFT bits as one; any count serves that is the same for all),
the others stand in hash order. What counts as many does not grow with the corpus.

 1. Equal sets are one class, known by a 128-bit digest; only classes are compared.
 2. Token frequencies: packed token arrays, counted in hash buckets. Where many rows are copies, only
    the row that stands for its class is counted and compared.
 3. Prefixes under the orders, packed likewise, without the tokens that only one set holds: a filter
    of FILTER bytes at most knows those that are counted twice, and lets others pass where it is full. A token
    is shipped with the class's number and the eighth of an octave that its set's size is in. Each
    bucket emits the pairs of classes that share a token, once; the orders' pairs are intersected, then
    thinned by sizes and bitmaps.
 4. A prefix token that too many classes hold emits no pairs: its classes are tied to a node
    that stands for the token. Classes that nodes connect are a dense group.
 5. Cells. A dense group becomes one cell, or if it is large blocks of bounded number and
    size, and each pair of blocks a cell. The other pairs' components are cells too; of a
    large one only those pairs of blocks that hold a pair, with the classes of these pairs.
    So a chain of candidates costs what its pairs do, and no task holds more than two blocks.
 6. A cell gets each of its sets once. It intersects the orders' filters among its own sets
    (for the tokens of nodes this happens only here), and verifies what passes, exactly.
 7. Links give components and counts; both go back to the documents by class.

A dense group of N similar sets takes (N / 1000)^2 / 2 cells: counting links among them is
quadratic, though no cell is larger than two blocks.

Nulls: a null text has an empty set. Empty sets link with nothing and are their own
component. Rows are compared by their texts, so rows that repeat an id may be in several
components; a row with a null id is compared like any other, and the id of a component is the
least that is not null, or null if all are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytesets as B
from quern.llm.common import as_long, drop, join_hot, keep, lean, small, text_column
from quern.llm.graph import components

SIZE, PERCENT = 5, 75
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
#: Tokens of at least this many documents stand last in every order, those of four times as many always are nodes.
COMMON = 32
#: Tokens that stand last at most, which bounds the table that is broadcast: where more would, the number is doubled until so many do.
MOST_COMMON = 4_000_000
#: Classes that share a token beyond which it is a node of its own instead of pairs.
MOST_PAIRED = 64
#: Classes and tokens of a block at most, but for a class that is larger by itself.
CELL, TOKENS_A_CELL = 1000, 1_000_000
TOKENS_A_BUCKET = 4_000_000
#: Bytes of the filter of repeated tokens at most, and bits a token where that allows them.
FILTER, FILTER_BITS = 128 << 20, 10
#: Low bits of a token's 32 in a bucket that do not count when tokens are counted.
SHIFT = 5
#: Bytes of a class's number among candidates.
REF_BYTES = 5
#: Classes whose rows are known by a broadcast of 8 bytes each at most, if one of COPIES rows is a copy.
MOST_OWN, COPIES = 8_000_000, 8
#: Entries of a cell's matrix that are worked on at once.
STRIPE = 1 << 18
_NO_ID = np.iinfo(np.int64).max


#: Bytes of text whose sets a worker holds at once.
PART = 8 << 20


def _sets(column: pa.Array, size: int):
    for data, offsets in B.slices(column, B.BLOCK):
        yield from B.shingles(data, offsets, size)


def _parts(batches, size: int, own=None):
    """Lists of the distinct sets, by digest, of about PART bytes of text at a time; of the rows (text, key) whose key is in own, if it is given."""
    for batch in batches:
        column = batch.column(0)
        if own is not None:
            column = column.take(pa.array(np.flatnonzero(_found(batch.column(1).to_numpy(), own.value)[0])))
        for data, offsets in B.slices(column, PART):
            sets = (s for i, j in B.blocks(offsets) for s in B.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size))
            yield {_digest(s): s for s in sets if len(s)}


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _ref(digest: bytes) -> int:
    """A class's number among candidates, not negative; classes that ever share one are candidates together."""
    return int.from_bytes(digest[:REF_BYTES], "little")


def _parity(tokens: np.ndarray) -> bytes:
    """A bitmap of at least two bits a token in which each token flips one bit."""
    bits = 64
    while bits < 2 * len(tokens):
        bits *= 2
    flips = np.bincount((B.mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(flips & 1).tobytes()


def _may_link(a: bytes, b: bytes, both: int, percent: int) -> bool:
    """Whether sets with these bitmaps, of so many tokens together, can be similar."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):  # bit i of a bitmap is bits i and i + half of one of twice its length
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    differ = int(_ONES[x ^ y].sum())
    return (100 + percent) * differ <= (100 - percent) * both


_ONES = np.array([bin(i).count("1") for i in range(256)])


def _thinned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that sizes and bitmaps leave; pairs with a token's node stay."""

    def thin(batches):
        for batch in batches:
            a, b, m, n, x, y = (c.to_pylist() for c in batch.columns)
            kept = [i for i in range(len(a)) if 100 * min(m[i], n[i]) >= percent * max(m[i], n[i]) and _may_link(x[i], y[i], m[i] + n[i], percent)]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    def side(name: str, n: str, bits: str) -> DataFrame:
        return classes.select(F.col("ref").alias(name), F.col("n").alias(n), F.col("parity").alias(bits))

    real = pairs.where("a >= 0").join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
    return real.mapInArrow(lean(thin), "a long, b long").distinct().unionByName(pairs.where("a < 0"))


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, digest, ref, parity of every row."""

    def sign(batches):
        for batch in batches:
            n, digests, parity = [], [], []
            for s in _sets(batch.column(2), size):
                n.append(len(s))
                digests.append(_digest(s))
                parity.append(_parity(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([_ref(d) for d in digests], pa.int64()), pa.array(parity, pa.binary())], names=["doc_id", "hash", "n_shingles", "digest", "ref", "parity"])

    texts = docs.select(as_long(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    return texts.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(lean(sign), "doc_id long, hash long, n_shingles long, digest binary, ref long, parity binary")


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1], True]) if len(sorted_keys) else np.zeros(1, np.int64)


def _filter_at(counted: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a bucket's filter that stands for a token (its bits that count)."""
    return (B.mix(counted.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _repeated(ids: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Which ids more than one set may hold; filters has a row of bytes a bucket."""
    at = _filter_at((ids & 0xFFFFFFFF) >> SHIFT, filters.shape[1] * 8)
    return filters[ids >> 32, at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _gaps(numbers: np.ndarray) -> bytes:
    """Sorted distinct numbers as two bytes for what lies between each and the one before; 65535 is that much more and no number."""
    gaps = np.diff(numbers, prepend=-1) - 1
    more = gaps // 65535
    out = np.full(len(gaps) + int(more.sum()), 65535, "<u2")
    out[np.arange(len(gaps)) + np.cumsum(more)] = gaps % 65535
    return out.tobytes()


def _numbers(gaps: bytes) -> np.ndarray:
    """The numbers that _gaps() was given."""
    steps = np.frombuffer(gaps, "<u2").astype(np.int64)
    more = steps == 65535
    return (np.cumsum(steps + ~more) - 1)[~more]


def common_tokens(texts: DataFrame, size: int, buckets: int, least: int, own=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted _counted() ids of tokens that at least so many sets hold, their counts, and the filter of tokens counted twice; a set counts once a part.

    Where more than MOST_COMMON tokens are held by so many, least is doubled until no more are.
    """
    width = max(64, min(FILTER // buckets, TOKENS_A_BUCKET * FILTER_BITS // 8 // 4))
    bits, doubled = 32 - SHIFT, 32

    def count(batches):
        for seen in _parts(batches, size, own):
            tokens, counts = np.unique(_counted(_ids(np.concatenate([np.empty(0, np.uint64), *seen.values()]), buckets)), return_counts=True)
            cuts = _cuts(tokens >> bits)
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                many = np.flatnonzero(counts[a:b] > 1)
                rows.append((tokens[a] >> bits, _gaps(tokens[a:b] & ((1 << bits) - 1)), many.astype("<u4").tobytes(), counts[a:b][many].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "many", "counts"])

    def total(table: pa.Table) -> pa.Table:
        tokens, counts = [], []
        for gaps, many, more in zip(*(table[c].to_pylist() for c in ("tokens", "many", "counts")), strict=True):
            tokens.append(_numbers(gaps).astype(np.uint32))
            counts.append(np.ones(len(tokens[-1]), np.uint32))
            counts[-1][np.frombuffer(many, "<u4")] = np.frombuffer(more, "<u4")
        found, at = np.unique(np.concatenate(tokens), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        bucket, kept = table["bucket"][0].as_py(), sums >= least
        filled = np.zeros(width * 8, bool)
        filled[_filter_at(found[sums > 1], width * 8)] = True
        packed = np.packbits(filled, bitorder="little").tobytes()
        held = [int((sums >= least << k).sum()) for k in range(doubled)]
        return pa.table({"bucket": [bucket], "token": pa.array([((np.int64(bucket) << bits) | found[kept].astype(np.int64)).tobytes()], pa.binary()), "n": pa.array([sums[kept].tobytes()], pa.binary()), "filter": pa.array([packed], pa.binary()), "held": pa.array([held], pa.list_(pa.int64()))})

    found = texts.mapInArrow(lean(count), "bucket long, tokens binary, many binary, counts binary").groupBy("bucket").applyInArrow(lean(total), "bucket long, token binary, n binary, filter binary, held array<long>")
    found = keep(found, "join-counts")
    held = np.array([r["held"] for r in found.select("held").collect()], np.int64).reshape(-1, doubled).sum(0)
    least = least << int(np.argmax(held <= MOST_COMMON))

    def cut(batches):
        for batch in batches:
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                token, n = np.frombuffer(token, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token[n >= least]), pa.array(n[n >= least])], names=["token", "n"])

    common = found.select("token", "n").mapInArrow(cut, "token long, n long").toArrow()
    token, n = common["token"].to_numpy(), common["n"].to_numpy()
    filters = np.zeros((buckets, width), np.uint8)
    for row in found.select("bucket", "filter").toLocalIterator():
        filters[row["bucket"]] = np.frombuffer(row["filter"], np.uint8)
    drop(found)
    order = np.argsort(token)
    return token[order], n[order], filters


def _prefix_length(n: int, percent: int) -> int:
    """How many first tokens of a set of n a similar set must share one of."""
    return n - -(-percent * n // 100) + 1


def _ids(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(tokens, buckets) << 32 | (tokens & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _counted(ids: np.ndarray) -> np.ndarray:
    """What counts of the ids when tokens are counted: tokens that agree in it are one."""
    return ids >> SHIFT


def _octave(sizes: np.ndarray) -> np.ndarray:
    """The eighth of an octave that a size is in."""
    return (8 * np.log2(sizes)).astype(np.uint8)


def _found(ids: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ids are among the sorted ones, and their places there."""
    at = np.minimum(np.searchsorted(common, ids), max(0, len(common) - 1))
    return (common[at] == ids if len(common) else np.zeros(len(ids), bool)), at


def _prefixes(tokens: np.ndarray, is_common: np.ndarray, sizes: np.ndarray, percent: int, seeds):
    """For each order the places in tokens of the sets' prefixes, set by set, and the prefixes' lengths."""
    first = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    lengths = [_prefix_length(int(n), percent) for n in sizes]
    for seed in seeds:
        key = B.mix(tokens ^ np.uint64(seed)) >> np.uint64(1)
        key[is_common] |= np.uint64(1 << 63)
        yield np.concatenate([first[i] + (np.argpartition(key[first[i] : first[i + 1]], p - 1)[:p] if p < n else np.arange(n)) for i, (n, p) in enumerate(zip(sizes, lengths, strict=True))]), lengths


def candidates(texts: DataFrame, size: int, percent: int, buckets: int, shared, seeds=SEEDS, own=None, filters=None) -> DataFrame:
    """Pairs (a, b) of class numbers that every order lets pass, and of classes with the nodes of tokens in any order.

    shared: a broadcast of the sorted ids of common tokens, and which of them always are nodes. own and filters: broadcasts of
    the keys of rows that stand for their class, and of the filter of repeated tokens.
    """
    every = (1 << len(seeds)) - 1
    dealt = 4 + buckets // 4  # few tokens of a bucket are left, and one that holds more of a set names it less often
    apart = math.ceil(8 * math.log2(100 / percent) + 0.01)  # eighths of an octave between similar sets at most

    def prefixes(batches):
        common, dense = shared.value
        for seen in _parts(batches, size, own):
            sets, digests = list(seen.values()), list(seen)
            if not sets:
                continue
            tokens = np.concatenate(sets)
            ids = _ids(tokens, buckets)
            is_common, at = _found(_counted(ids), common)
            is_dense = is_common & dense[at] if len(common) else is_common
            refs, sizes = np.array([_ref(d) for d in digests], "<i8"), np.array([len(s) for s in sets], np.int64)
            short, octaves = refs.view(np.uint8).reshape(-1, 8)[:, :REF_BYTES], _octave(sizes)
            alone = ~_repeated(ids, filters.value) if filters is not None else np.zeros(len(ids), bool)
            for o, (chosen, lengths) in enumerate(_prefixes(tokens, is_common, sizes, percent, seeds)):
                owner = np.repeat(np.arange(len(sets)), lengths)
                met = ~alone[chosen]  # a token of one set makes no pair
                chosen, owner = chosen[met], owner[met]
                chosen_ids, heavy = ids[chosen], is_dense[chosen]
                # tokens with a node of their own need no company: they go to any bucket, below zero
                where = np.where(heavy, -1 - refs[0] % buckets, (chosen_ids >> 32) % dealt)
                order = np.lexsort((owner, where))
                cuts = _cuts(where[order])
                rows = []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    o_ = order[a:b]
                    new = np.diff(owner[o_], prepend=-1) > 0  # the first token of each set
                    mine = owner[o_][new]
                    rows.append((int(where[o_[0]]), o, (chosen_ids[o_].astype("<i8") if where[o_[0]] < 0 else (chosen_ids[o_] & 0xFFFFFFFF).astype("<u4")).tobytes(), short[mine].tobytes(), octaves[mine].tobytes(), np.packbits(new).tobytes()))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "nth", "tokens", "refs", "octaves", "new"])

    def unpack(table: pa.Table, kind: str):
        tokens = [np.frombuffer(x, kind) for x in table["tokens"].to_pylist()]
        new = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(t)) for x, t in zip(table["new"].to_pylist(), tokens, strict=True)])
        short = np.frombuffer(b"".join(table["refs"].to_pylist()), np.uint8).reshape(-1, REF_BYTES)
        refs = np.zeros((len(short), 8), np.uint8)
        refs[:, :REF_BYTES] = short
        owner = np.cumsum(new, dtype=np.int32) - 1
        octaves = np.frombuffer(b"".join(table["octaves"].to_pylist()), np.uint8)
        return np.concatenate(tokens), refs.view("<i8").ravel()[owner], octaves[owner]

    def nodes(ids: np.ndarray) -> np.ndarray:
        return -1 - ids

    def pairs_of(table: pa.Table) -> pa.Table:
        bucket, nth = table["bucket"][0].as_py(), table["nth"][0].as_py()
        if bucket < 0:
            ids, refs, _ = unpack(table, "<i8")
            return pa.table({"a": nodes(ids), "b": refs, "mask": pa.array(np.full(len(refs), every, np.int32))})
        tokens, refs, octaves = unpack(table, "<u4")
        order = np.lexsort((refs, tokens))
        tokens, refs, octaves = tokens[order], refs[order], octaves[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (refs[1:] != refs[:-1])]
        tokens, refs, octaves = tokens[new], refs[new], octaves[new].astype(np.int16)
        cuts = _cuts(tokens)
        length, first = np.diff(cuts), cuts[:-1]
        a, b, tied = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for k in np.unique(length[(length > 1) & (length <= MOST_PAIRED)]):
            rows = first[length == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            x, y = rows[:, i].ravel(), rows[:, j].ravel()
            near = np.abs(octaves[x] - octaves[y]) <= apart
            a.append(refs[x[near]])
            b.append(refs[y[near]])
        for s, k in zip(first[length > MOST_PAIRED], length[length > MOST_PAIRED], strict=True):
            tied.append((np.repeat(nodes(np.int64(bucket) << 32 | tokens[s : s + 1].astype(np.int64)), k), refs[s : s + k]))
        a, b = np.concatenate(a), np.concatenate(b)
        mask = np.full(len(a), 1 << nth, np.int32)
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            a, b, mask = a[new], b[new], mask[new]
        for x, y in tied:
            a, b, mask = np.r_[a, x], np.r_[b, y], np.r_[mask, np.full(len(x), every, np.int32)]
        return pa.table({"a": a, "b": b, "mask": pa.array(mask, pa.int32())})

    packed = texts.mapInArrow(lean(prefixes), "bucket long, nth int, tokens binary, refs binary, octaves binary, new binary")
    found = packed.groupBy("bucket", "nth").applyInArrow(lean(pairs_of), "a long, b long, mask int")
    return found.groupBy("a", "b").agg(F.bit_or("mask").alias("mask")).where(F.col("mask") == every).select("a", "b")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections (float32), by a product of incidence matrices."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    first = np.r_[True, tokens[1:] != tokens[:-1]]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, 4_000_000 // len(sets))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        total += m @ m.T
    return total


def _stripes(n: int):
    """Slices of the rows of a matrix of n columns, so that what is computed of them stays small."""
    step = max(1, STRIPE // max(1, n))
    return (slice(i, i + step) for i in range(0, n, step))


def _candidate_pairs(sets: list[np.ndarray], sizes: np.ndarray, percent: int, buckets: int, common: np.ndarray, seeds) -> np.ndarray:
    """Which pairs of sets pass the filters of all orders and that of sizes."""
    tokens = np.concatenate(sets)
    is_common, _ = _found(_counted(_ids(tokens, buckets)), common)
    out = np.empty((len(sets),) * 2, bool)
    for k in _stripes(len(sets)):
        out[k] = 100 * np.minimum(sizes[k, None], sizes) >= percent * np.maximum(sizes[k, None], sizes)
    np.fill_diagonal(out, False)
    for chosen, lengths in _prefixes(tokens, is_common, sizes, percent, seeds):
        if not out.any():
            break
        out &= _overlaps(np.split(tokens[chosen], np.cumsum(lengths)[:-1])) > 0
    return out


def _shared(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of these pairs; what stands for others says nothing."""
    i, j = np.nonzero(np.triu(pairs))
    if len(i) > 4 * len(sets):
        used = np.flatnonzero(pairs.any(1))
        if len(used) == len(sets):
            return _overlaps(sets)
        out = np.zeros(pairs.shape, np.float32)
        out[np.ix_(used, used)] = _overlaps([sets[k] for k in used])
        return out
    out = np.zeros(pairs.shape, np.float32)
    for a, b in zip(i, j, strict=True):
        out[a, b] = out[b, a] = len(sets[a]) + len(sets[b]) - len(np.union1d(sets[a], sets[b]))
    return out


def verify(cells: DataFrame, percent: int, buckets: int, shared, seeds=SEEDS) -> DataFrame:
    """Links of cells (comp, x, y, block, dense, num, copies, tokens): num, root (least num linked in the cell), links.

    Of two blocks only pairs across count, and outside dense groups only pairs that are in none together.
    """

    def links(rows):
        x, y = rows[0][1], rows[0][2]
        sets = [np.frombuffer(r[7], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets], np.int64)
        block, dense, num, copies = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6))
        apart = block[:, None] != block if x != y else np.ones((len(rows),) * 2, bool)
        if rows[0][0] >= 0:
            apart &= (dense[:, None] != dense) | (dense >= 0)
        linked = np.zeros_like(apart)
        pairs = _candidate_pairs(sets, sizes, percent, buckets, shared.value[0], seeds) & apart
        if pairs.any():
            both = _shared(sets, pairs)
            for k in _stripes(len(rows)):
                same = both[k].astype(np.int64)
                linked[k] = pairs[k] & (100 * same >= percent * (sizes[k, None] + sizes - same))
            del both
        root = num.copy()
        while True:
            least = [np.where(linked[k], root[None, :], np.iinfo(np.int64).max).min(1) for k in _stripes(len(rows))]
            new = np.minimum(root, np.concatenate(least))
            if (new == root).all():
                break
            root = new
        return num, root, np.concatenate([linked[k].astype(np.int64) @ copies for k in _stripes(len(rows))])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    done.append(links(held))
                    held = []
                if not held or held[-1][5] != row[5]:  # rows of one id and text ship their set alike
                    held.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[k] for d in done])) for k in range(3)], names=["num", "root", "links"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in links(held)], names=["num", "root", "links"])

    columns = ["comp", "x", "y", "block", "dense", "num", "copies", "tokens"]
    return cells.select(columns).repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y", "num").mapInArrow(lean(run), "num long, root long, links long")


def _blocks(members: DataFrame, cell: int, tokens: int) -> DataFrame:
    """members (ref, comp, n, ...) with the number of blocks of their group and their own."""
    counted = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / cell), F.ceil(F.sum("n") / tokens)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"))
    counted = keep(counted, "join-blocks")
    joined = join_hot(members, counted, ["comp"], "size", members.count())
    return joined.withColumn("block", F.pmod(F.xxhash64("ref", F.lit(1)), F.col("blocks")).cast("int")).drop("size")


def _places(pairs: DataFrame, classes: DataFrame, cell: int, tokens: int) -> DataFrame:
    """ref, dense (its dense group, or 0), and places: an array of (comp, x, y, block), a cell each, for every class that a cell needs."""
    place = lambda x, y: F.struct("comp", F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "block")
    sizes = classes.groupBy("ref").agg(F.max("n").alias("n"))
    dense = keep(components(pairs.where("a < 0")).where("node >= 0").select(F.col("node").alias("ref"), F.col("component").alias("comp")), "join-dense")
    tied = keep(_blocks(dense.join(sizes, "ref"), cell, tokens), "join-tied")
    every = tied.select("ref", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("ref", place(F.col("block"), F.col("other")).alias("place"))
    in_group = lambda name: dense.select(F.col("ref").alias(name), F.col("comp").alias(f"{name}_group"))
    rest = pairs.where("a >= 0").join(in_group("a"), "a", "left").join(in_group("b"), "b", "left").where("a_group IS NULL OR b_group IS NULL OR a_group <> b_group").select("a", "b")
    rest = keep(rest, "join-rest")
    loose = components(rest).select(F.col("node").alias("ref"), F.col("component").alias("comp"))
    loose = keep(_blocks(loose.join(sizes, "ref"), cell, tokens), "join-loose")
    whole = loose.where("blocks = 1").select("ref", place(F.col("block"), F.col("block")).alias("place"))
    large = loose.where("blocks > 1").select("ref", "comp", "block")
    both = rest.join(large.withColumnRenamed("ref", "a"), "a").join(large.select(F.col("ref").alias("b"), F.col("block").alias("other")), "b")
    ends = both.select(F.col("a").alias("ref"), "comp", "block", "other").unionByName(both.select(F.col("b").alias("ref"), "comp", F.col("other").alias("block"), F.col("block").alias("other")))
    parts = ends.select("ref", place(F.col("block"), F.col("other")).alias("place")).distinct()
    gathered = every.unionByName(whole).unionByName(parts).groupBy("ref").agg(F.collect_list("place").alias("places"))  # at most a place a block
    return gathered.join(dense.select("ref", F.col("comp").alias("dense")), "ref", "left").select("ref", F.coalesce("dense", F.lit(0)).alias("dense"), "places")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, cell: int = CELL, tokens_a_bucket: int = TOKENS_A_BUCKET, common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), n_links (other rows it links with)."""
    return row_groups(docs, id_col=id_col, text_col=text_col, size=size, percent=percent, cell=cell, tokens_a_bucket=tokens_a_bucket, common=common).select("doc_id", "n_shingles", "component_id", "n_links")


def row_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, cell: int = CELL, tokens_a_bucket: int = TOKENS_A_BUCKET, common: int = COMMON) -> DataFrame:
    """similar_groups() with hash (xxhash64 of the row's text), and first: whether the row stands for its component.

    That is the row of the least id there, a null id last, of equal ids the least hash; of rows
    equal in both all are marked. A row of an empty set stands for itself.
    """
    texts = docs.select(as_long(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    key = lambda i, h: F.xxhash64(F.coalesce(i, F.lit(_NO_ID)), h).alias("key")
    compared = texts.select("text", key(F.col("doc_id"), F.xxhash64("text")))
    signed = keep(signatures(texts, size=size), "join-signatures")
    own = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "hash")
    found = signed.where("n_shingles > 0").groupBy("digest", "ref").agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"))
    classes = keep(found.withColumn("num", F.monotonically_increasing_id()), "join-classes")
    whole, signed = signed, keep(signed.drop("ref", "parity"), "join-signatures")
    drop(whole)
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = int(total // tokens_a_bucket) + 8
    context, n_classes, own = docs.sparkSession.sparkContext, classes.count(), None
    if n_classes <= MOST_OWN and signed.where("n_shingles > 0").count() * (COPIES - 1) > n_classes * COPIES:
        own = context.broadcast(np.sort(classes.select(key(F.col("own.id"), F.col("own.hash"))).toArrow()["key"].to_numpy()))
    tokens, counts, filters = common_tokens(compared, size, buckets, common, own)
    shared, filters = context.broadcast((tokens, counts > 4 * common)), context.broadcast(filters)
    raw = keep(candidates(compared, size, percent, buckets, shared, own=own, filters=filters), "join-pairs")
    pairs = keep(_thinned(raw, classes, percent), "join-pairs")
    filters.unpersist()
    whole, classes = classes, keep(classes.drop("parity"), "join-classes")
    drop(raw, whole)
    member = classes.drop("n").join(_places(pairs, classes, cell, TOKENS_A_CELL), "ref").select(F.col("own.id").alias("id"), F.col("own.hash").alias("hash"), "digest", "num", "copies", "dense", "places")
    member = keep(member, "join-members")

    def ship(batches):
        for batch in batches:
            kept = [(i, s) for i, (s, d) in enumerate(zip(_sets(batch.column(0), size), batch.column(1).to_pylist(), strict=True)) if _digest(s) == d]
            picked = batch.take(pa.array([i for i, _ in kept], pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns[2:], pa.array([s.tobytes() for _, s in kept], pa.binary())], names=["num", "copies", "dense", "places", "tokens"])

    named = texts.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    schema = "num long, copies long, dense long, places array<struct<comp:long,x:int,y:int,block:int>>, tokens binary"
    sets = named.join(small(member), ["id", "hash"]).select("text", "digest", "num", "copies", "dense", "places").mapInArrow(lean(ship), schema)
    cells = sets.select("num", "copies", "dense", "tokens", F.explode("places").alias("place")).select("place.*", "num", "copies", "dense", "tokens")
    links = keep(verify(cells, percent, buckets, shared), "join-links")
    joined = components(links.select(F.col("num").alias("a"), F.col("root").alias("b")).where("a <> b"))
    degree = links.groupBy("num").agg(F.sum("links").alias("links"))
    grouped = classes.select("num", "digest", "copies", "own").join(joined.withColumnRenamed("node", "num"), "num", "left").join(degree, "num", "left")
    grouped = keep(grouped.select("digest", "copies", "own", F.coalesce("component", "num").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "join-grouped")
    heads = keep(grouped.groupBy("component").agg(F.min("own").alias("head"), F.count(F.lit(1)).alias("size")), "join-heads")
    by_class = join_hot(grouped.drop("own"), heads, ["component"], "size", grouped.count())
    rows = signed.where("n_shingles > 0").select("doc_id", "hash", "n_shingles", "digest")
    filled = join_hot(rows, keep(by_class.select("digest", "copies", "n_links", "head"), "join-classes"), ["digest"], "copies", signed.count())
    filled = filled.select(
        "doc_id", "hash", "n_shingles", F.nullif(F.col("head.id"), F.lit(_NO_ID)).alias("component_id"), "n_links",
        ((F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("head.id")) & (F.col("hash") == F.col("head.hash"))).alias("first"),
    )
    blank = signed.where("n_shingles = 0").select("doc_id", "hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return filled.unionByName(blank)


def query(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
