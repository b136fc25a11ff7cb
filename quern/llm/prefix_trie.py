"""The trie of rebuilt conversations: an external mergesort that carries LCPs, and a stack of open paths.

A turn is known by the SHA-256 of its role and text, a conversation by the path of its
turns' digests; texts are read once and never shuffled with it. Equal paths are one item
with the count, the least id and the digest of the ids of its conversations, so a conversation
that a third of all rows repeat is one item (its ids are packed in sorted chunks that are
streamed into the digest; no list of them is held).

Items are sorted in two steps. A map task sorts what fits in its memory into runs and
hands each item on with its LCP, the number of turns that it shares with the item before it
in the run, and only the turns after those. Splitters, sampled items, cut the order into buckets
of bounded size wherever it is dense, a hot first turn included. A bucket's runs are merged by
a loser tree of LCPs: of two heads the one with the longer LCP to the last item put out comes
first, and turns are compared only from an equal LCP on, so shared turns are never compared
again. Whatever the merge puts out goes through a stack of open nodes, and nodes that it leaves
are finished.

A node on the path of a bucket's first item, or of the first item of the next bucket (a
splitter, so known), may lie in several buckets. These few are put out as sums that add up;
a node counts as a child, and its text's bytes as held once, where it is left, and the next
item says so in every bucket. All other nodes are final as they are.

Rows without conv_id belong to no conversation. Turns are ordered by turn (null first), then
role, then the digest, so ties have one order and repeated rows are repeated turns. A null role
or text is empty. c % 5 has the sign of c. No rows give no node. One conversation's digests (40
bytes a turn) are held by one task; texts are not.
"""

from __future__ import annotations

import bisect
import hashlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_long, drop, join_hot, keep, lean

#: Conversations that share a base, and the modulus of how many of its turns they take.
FAMILY, HEADS = 5, 9
DIGEST = 32
#: Turns in a bucket, turns in a sorted run, and bytes of ids in a chunk.
BUCKET_TURNS, RUN_TURNS, CHUNK = 200_000, 200_000, 1 << 16
#: Sampled items for each bucket; the driver holds so many bytes of sampled paths at most.
SAMPLES, SAMPLE_BYTES = 16, 64 << 20
NO_IDS = hashlib.sha256(b"").hexdigest()
ITEM = "path binary, sizes array<long>, n long, conv long, ends string"
NODE = "id binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, repeated long, once long, ends string, edge boolean"


def ordered(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns in order, each with its digest and the bytes of its text."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turn = F.struct(as_long(conversations, turn_col).alias("turn"), role.alias("role"), named.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    turns = conversations.select(as_long(conversations, id_col).alias("conv_id"), turn.alias("t")).where("conv_id is not null")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, path (joined digests of turns) and sizes (bytes of their texts) of each rebuilt conversation."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    whole = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("taken", taken).join(heads, "base", "left")
    first = F.coalesce(F.expr("slice(head, 1, taken)"), F.expr("slice(turns, 1, 0)"))
    path = F.concat(first, F.expr("slice(turns, taken + 1, greatest(size(turns) - taken, 0))"))
    digests = F.unhex(F.array_join(F.transform("path", lambda t: t["digest"]), ""))
    return whole.select("conv_id", path.alias("path")).select("conv_id", digests.alias("path"), F.transform("path", lambda t: t["size"]).alias("sizes"))


def _pack_ids(batches):
    """Rows sorted by path and id, as one row a chunk of a path's ids: their text, number and least."""
    path, sizes, ids, held = None, None, [], 0

    def chunk():
        return pa.RecordBatch.from_arrays(
            [pa.array([path], pa.binary()), pa.array([sizes], pa.list_(pa.int64())), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids)).encode()], pa.binary())],
            names=["path", "sizes", "conv", "n", "text"],
        )

    for batch in batches:
        for p, s, c in zip(*(batch.column(n).to_pylist() for n in ("path", "sizes", "conv_id")), strict=True):
            if path is not None and (p != path or held >= CHUNK):
                yield chunk()
                ids, held = [], 0
            path, sizes = p, s
            ids.append(c)
            held += 20
    if ids:
        yield chunk()


def _fold_ids(batches):
    """Chunks sorted by path and least id, as one item a path; ids go through the digest chunk by chunk."""
    path, out, digest = None, [], None
    for batch in batches:
        for p, s, conv, n, text in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "conv", "n", "text")), strict=True):
            if p == path:
                digest.update(b"," + text)
                out[-1][2] += n
                continue
            if out:
                out[-1][4] = digest.hexdigest()
            if len(out) >= 1000:
                yield _items(out)
                out = []
            path, digest = p, hashlib.sha256(text)
            out.append([p, s, n, conv, None])
    if out:
        out[-1][4] = digest.hexdigest()
        yield _items(out)


def _items(rows):
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "sizes", "n", "conv", "ends"])


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two paths share, of which the first `at` are known to be equal."""
    most = min(len(a), len(b)) // DIGEST
    while at < most and a[at * DIGEST : (at + 1) * DIGEST] == b[at * DIGEST : (at + 1) * DIGEST]:
        at += 1
    return at


def sorted_runs(splitters: list[bytes], run_turns: int):
    """Items as sorted runs: bucket, run, place in it, LCP with the item before it there, and the turns after that."""

    def emit(rows, run):
        rows.sort(key=lambda r: r[0])
        out, before, last = [], b"", None
        for place, (path, sizes, n, conv, ends) in enumerate(rows):
            bucket = bisect.bisect_right(splitters, path)
            lcp = shared_turns(before, path) if bucket == last else 0
            before, last = path, bucket
            out.append((bucket, run, place, lcp, path[lcp * DIGEST :], sizes[lcp:], n, conv, ends))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        names = ["bucket", "run", "place", "lcp", "path", "sizes", "n", "conv", "ends"]
        for k in range(0, len(out), 5000):
            part = out[k : k + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate(kinds)], names=names)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += 1 + len(row[1])
                if size >= run_turns:
                    yield from emit(held, number)
                    held, size, number = [], 0, number + 1
        yield from emit(held, number)

    return run


def merged(runs: list[list[tuple]]):
    """Items of runs in order, each with its LCP with the one put out before it: a loser tree that compares LCPs first.

    A run is a list of (lcp, suffix, sizes, n, conv, ends); what is given is (lcp, path, sizes, n, conv, ends).
    An inner node of the tree holds the loser of the match there; a head's LCP is always that with the
    last winner it lost to, which is all that its next match needs.
    """
    k = len(runs)
    at = [0] * k
    paths, lens, lcps = [b""] * k, [[]] * k, [0] * k

    def advance(r: int) -> bool:
        if at[r] == len(runs[r]):
            lcps[r] = -1  # beyond the last item: loses against everything
            return False
        lcp, suffix, sizes = runs[r][at[r]][:3]
        paths[r] = paths[r][: lcp * DIGEST] + suffix
        lens[r] = lens[r][:lcp] + sizes
        lcps[r] = lcp
        at[r] += 1
        return True

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP becomes that with the winner."""
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        if lcps[a] < 0:
            return a, b
        here = shared_turns(paths[a], paths[b], lcps[a])
        first, last = (a, b) if paths[a][here * DIGEST : (here + 1) * DIGEST] < paths[b][here * DIGEST : (here + 1) * DIGEST] else (b, a)
        lcps[last] = here
        return first, last

    for r in range(k):
        advance(r)
    loser = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        first, loser[node] = match(play(2 * node), play(2 * node + 1))
        return first

    winner = play(1) if k > 1 else 0
    while lcps[winner] >= 0:
        yield (lcps[winner], paths[winner], lens[winner], *runs[winner][at[winner] - 1][3:])
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, loser[node] = match(winner, loser[node])
            node //= 2


def nodes_of(items, following: bytes | None):
    """Rows of NODE for a bucket's items in order; `following` is the next bucket's first path, None after the last.

    Nodes are numbered as they open, so a parent's least id is there when the bucket ends, and no row waits for another.
    """
    kinds = "conv depth parent n children leaves repeated once edge".split()
    col = {c: array("q") for c in kinds}
    ends: dict[int, str] = {}
    keys: dict[int, bytes] = {}
    stack: list[int] = []  # open nodes, from the root
    sizes: list[int] = [0]  # bytes of their texts
    chain = [hashlib.sha256()]  # of the paths of open edge nodes

    def push(depth: int, size: int, turn: bytes, edge: bool) -> None:
        node = len(col["n"])
        for c, v in zip(kinds, (1 << 62, depth, stack[-1] if stack else -1, 0, 0, 0, 0, 0, int(edge)), strict=True):
            col[c].append(v)
        del sizes[depth:]
        sizes.append(size)
        if edge:
            del chain[max(depth, 1) :]
            if depth:
                chain.append(chain[-1].copy())
                chain[-1].update(turn)
            keys[node] = chain[-1].digest()
        stack.append(node)

    def leave(depth: int, finished: bool) -> None:
        """Close open nodes deeper than depth."""
        while len(stack) - 1 > depth:
            node = stack.pop()
            size = sizes[len(stack)]
            col["repeated"][node] += col["n"][node] * size
            col["once"][node] += size if finished else 0
            if stack:
                up = stack[-1]
                col["children"][up] += finished
                col["conv"][up] = min(col["conv"][up], col["conv"][node])
                for c in ("n", "leaves", "repeated", "once"):
                    col[c][up] += col[c][node]

    before = None
    for lcp, path, lens, n, conv, end in items:
        if before is None:
            push(0, 0, b"", True)
            lcp = 0
        else:
            if lcp < len(before) // DIGEST:
                col["leaves"][stack[-1]] += 1
            leave(lcp, True)
        for depth in range(lcp + 1, len(path) // DIGEST + 1):
            push(depth, lens[depth - 1], path[(depth - 1) * DIGEST : depth * DIGEST], before is None)
        last = stack[-1]
        col["n"][last] += n
        col["conv"][last] = min(col["conv"][last], conv)
        ends[last] = end
        before = path
    if before is None:
        return
    shared = -1 if following is None else shared_turns(before, following)
    if shared < len(before) // DIGEST:
        col["leaves"][stack[-1]] += 1
    leave(shared, True)
    digest = hashlib.sha256()  # nodes that the next bucket goes on with
    for depth, node in enumerate(stack):
        if depth:
            digest.update(before[(depth - 1) * DIGEST : depth * DIGEST])
        col["edge"][node], keys[node] = 1, digest.digest()
    leave(-1, False)
    total = len(col["n"])
    for a in range(0, total, 5000):
        some = range(a, min(total, a + 5000))
        up = [col["parent"][i] for i in some]
        final = [p >= 0 and not col["edge"][p] for p in up]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([keys.get(i) for i in some], pa.binary()),
                pa.array([keys.get(p) for p in up], pa.binary()),
                pa.array(col["conv"][a : some.stop]),
                pa.array(col["depth"][a : some.stop]),
                pa.array([col["conv"][p] if f else None for p, f in zip(up, final, strict=True)], pa.int64()),
                *(pa.array(col[c][a : some.stop]) for c in ("n", "children", "leaves", "repeated", "once")),
                pa.array([ends.get(i) for i in some], pa.string()),
                pa.array([bool(col["edge"][i]) for i in some]),
            ],
            names=[x.split()[0] for x in NODE.split(", ")],
        )


def merge_buckets(splitters: list[bytes]):
    """Rows sorted by bucket, run and place, as nodes; one bucket is held at a time."""

    def nodes(bucket, runs):
        following = splitters[bucket] if bucket < len(splitters) else None
        yield from nodes_of(merged(list(runs.values())), following)

    def run(batches):
        bucket, runs = None, {}
        for batch in batches:
            for b, number, _, *item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and bucket is not None:
                    yield from nodes(bucket, runs)
                    runs = {}
                bucket = b
                runs.setdefault(number, []).append(tuple(item))
        if bucket is not None:
            yield from nodes(bucket, runs)

    return run


def _splitters(items: DataFrame, bucket_turns: int) -> list[bytes]:
    """Sorted paths that cut the items into buckets; a sample of bounded bytes chooses them."""
    count, turns = items.agg(F.count(F.lit(1)), F.sum(F.size("sizes") + 1)).first()
    buckets = (turns or 0) // bucket_turns + 1
    if buckets == 1:
        return []
    share = min(1.0, SAMPLES * buckets / count, SAMPLE_BYTES / (turns * DIGEST))
    sample = sorted(bytes(r[0]) for r in items.select("path").sample(share, seed=1).collect())
    step = max(1, len(sample) // buckets)
    return sample[step::step]


def trie(conversations: DataFrame, *, bucket_turns: int = BUCKET_TURNS, run_turns: int = RUN_TURNS, **columns) -> DataFrame:
    """One row a node of the trie of rebuilt conversations."""
    own = keep(ordered(conversations, **columns), "trie-own")
    convs = keep(rebuilt(own), "trie-convs")
    drop(own)
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of a path's hash and the ids: a path's ids lie side by side, and many of them in many tasks
    chunks = convs.repartitionByRange(parts, F.xxhash64("path"), "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(lean(_pack_ids), "path binary, sizes array<long>, conv long, n long, text binary")
    items = keep(chunks.repartition("path").sortWithinPartitions("path", "conv").mapInArrow(lean(_fold_ids), ITEM), "trie-items")
    drop(convs)
    splitters = _splitters(items, bucket_turns)
    runs = items.mapInArrow(lean(sorted_runs(splitters, run_turns)), "bucket int, run long, place long, lcp long, path binary, sizes array<long>, n long, conv long, ends string")
    dealt = runs.repartition(len(splitters) + 1, "bucket").sortWithinPartitions("bucket", "run", "place")
    found = keep(dealt.mapInArrow(lean(merge_buckets(splitters)), NODE), "trie-nodes")
    drop(items)

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "repeated", "once")]
    edges = keep(found.where("edge").groupBy("id").agg(F.first("parent", True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends").alias("ends")), "trie-edges")
    above = edges.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    open_rows = found.where("not edge and parent is not null").drop("parent_conv_id", "edge").unionByName(edges.where("parent is not null"))
    below = join_hot(open_rows, above.withColumnRenamed("n_children", "meets"), ["parent"], "meets", found.count())
    rows = found.where("not edge and parent is null").drop("edge").unionByName(below.drop("meets")).unionByName(edges.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("repeated") - F.col("once")).alias("saved_tokens"), ends)


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
with own as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce("text", '')} order by turn nulls first, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', role, "text"))) as turns
  from conversations where conv_id is not null group by conv_id
), takes as (
  select *, conv_id - conv_id % 5 as base,
         xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end))) % 9 as h
  from own
), convs as (
  select t.conv_id, list_concat(case when h > 0 then coalesce(b.turns[1:h], []) else [] end, t.turns[h + 1:]) as path from takes t left join own b on b.conv_id = t.base
), members as (
  select conv_id, path, d as depth, path[1:d] as prefix from (select conv_id, path, unnest(range(len(path) + 1)) as d from convs)
), nodes as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(sha256(string_agg(case when len(path) = depth then conv_id::varchar end, ',' order by conv_id)), sha256('')) as ends_sha256,
         case when depth = 0 then 0 else (count(*) - 1) * strlen(prefix[depth].text) end as saved
  from members group by prefix, depth
), grown as (
  select n.*, (select count(*) from nodes c where c.depth = n.depth + 1 and c.prefix[1:n.depth] = n.prefix) as n_children from nodes n
), above as (
  select prefix[1:d] as top, saved, n_children from (select *, unnest(range(depth + 1)) as d from grown)
), sums as (
  select top, sum(saved) as saved_tokens, count(*) filter (n_children = 0) as n_leaves from above group by top
)
select g.conv_id, g.depth::bigint as depth, p.conv_id as parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, g.ends_sha256
from grown g join sums s on s.top = g.prefix left join nodes p on g.depth > 0 and p.depth = g.depth - 1 and p.prefix = g.prefix[1:g.depth - 1]
"""
