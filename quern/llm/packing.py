"""Best-fit packing of tokenised documents by linear grouping.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at
most `capacity` counts, whatever the number of documents. The driver packs that
histogram. Pieces of the whole capacity stand alone. Other large lengths (over a third of
the capacity) are sorted and cut into `groups` groups of equal cardinality, each rounded
up to its largest length. A linear programme over the configurations of those few
sizes, its columns made by a knapsack as the duals ask for them, says how often each
configuration is used in the fewest sequences. Actual lengths are substituted for the
rounded ones: each place takes the largest that fits, and what is left of the fractions
is filled by its actual lengths. Small lengths then go, longest first, into the fullest
sequence that still has room. Equal sequences are handled as one run with a count, so
the plan has a few thousand rows at any scale.

Each document then finds its place by its rank among pieces of equal length. Ranks are
counted inside hash buckets and shifted by the buckets before, so a length that a
third of all documents share is many tasks.

Texts are tokenised once; a document is its ids followed by the end id. Documents
longer than the capacity are cut into full pieces, the remainder first.

Nulls: a null text is empty and is packed as its end id alone. Repeated rows and null
ids are packed like any other row, one place each. Long runs of blanks are tokenised
whole. An empty table gives no rows. Columns other than id and text are not carried.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import as_long, keep, lean, small, text_column

CAPACITY = 1024
END_ID = 2
GROUPS = 64
#: Lengths of more than capacity / SMALL are large.
SMALL = 3
PIECES_A_BUCKET = 500_000

#: A run of blanks that is long: tiktoken's pattern walks one recursively, and overflows its stack somewhere beyond 50,000.
LONG_BLANK = re.compile(r"(?<!\s)\s{5000}")

_ENCODERS: dict = {}


def encoder(vocabulary: str):
    """A function from texts to lists of ids: those of `tokenizers` for a byte-level BPE file.

    The ids are computed by tiktoken over the same merges, several times as fast; texts
    that hold a special token's string or a long run of blanks go through `tokenizers`
    itself. A vocabulary whose ids are not in the order of its merges, or whose splitting is
    not the usual byte-level one, goes through `tokenizers` throughout.
    """
    if vocabulary not in _ENCODERS:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]

        def slow(texts):
            return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]

        ranks = _ranks(spec)
        if ranks is None:
            _ENCODERS[vocabulary] = slow
        else:
            import public_tokenizers
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _ENCODERS[vocabulary] = lambda texts: [slow([t])[0] if any(s in t for s in special) or LONG_BLANK.search(t) else fast.encode_ordinary(t) for t in texts]
    return _ENCODERS[vocabulary]


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes to ids, if the file is a byte-level BPE whose ids follow the order of its merges."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
        return None
    changes = (spec.get("normalizer"), spec.get("truncation"), spec.get("padding"))
    if any(changes) or any(model.get(x) for x in ("ignore_merges", "byte_fallback", "dropout", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [ranks[b"".join(bytes(alphabet[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    except KeyError:
        return None
    return ranks if merged == sorted(merged) else None


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document, uncut if it fits."""
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], [], []]
            for i in range(0, len(texts), 64):
                for key, ids in zip(keys[i : i + 64], encode(texts[i : i + 64]), strict=True):
                    ids = np.array([*ids, end_id], "<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        for column, value in zip(rows, (key, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None), strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows[:n], kinds[:n], strict=True)], names=names[:n])

    return docs.select(as_long(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text")).mapInArrow(lean(cut), schema)


@dataclass
class Run:
    """count equal sequences: the i-th holds, for each item (length, rank), the piece of that length with rank + i."""

    count: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def split(self, k: int) -> Run:
        """Take the first k sequences off."""
        taken = Run(k, self.room, list(self.items))
        self.count -= k
        self.items = [(length, rank + k) for length, rank in self.items]
        return taken


def grouped(histogram: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths in falling order cut into groups of equal cardinality: each a list of [length, first rank, count]."""
    total = sum(histogram.values())
    per = -(-total // groups) if total else 1
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if not room:
                out.append([])
                room = per
            n = min(room, left)
            out[-1].append([length, rank, n])
            rank, left, room = rank + n, left - n, room - n
    return out


def best_fill(rest: int, sizes: list[int], counts: list[int]) -> list[int]:
    """Indexes of sizes (at most counts of each) whose sum is the largest that is at most rest."""
    reach, mask, layers = 1, (1 << (rest + 1)) - 1, []
    for g, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        for _ in range(min(count, rest // size) if size else 0):
            more = (reach << size) & mask & ~reach
            if not more:
                break
            layers.append((g, more))
            reach |= more
            if reach >> rest & 1:
                break
        if reach >> rest & 1:
            break
    at, used = reach.bit_length() - 1, []
    for g, new in reversed(layers):
        if at and new >> at & 1:
            used.append(g)
            at -= sizes[g]
    return used


def best_pattern(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity whose values sum highest: that sum, and how often each size is in it."""
    of = np.array(sizes)
    left = np.arange(capacity + 1)[:, None] - of
    best, layers = np.zeros(capacity + 1), []
    for _ in range(capacity // int(of.min())):  # one more piece a layer
        worth = np.where(left >= 0, best[left] + values, -1.0)
        k = worth.argmax(1)
        more = worth[np.arange(capacity + 1), k]
        layers.append(np.where(more > best, k, -1))
        best = np.maximum(best, more)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for layer in reversed(layers):
        if layer[room] >= 0:
            counts[layer[room]] += 1
            room -= of[layer[room]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns of sizes and how often each is used, fractions allowed, that hold the counts in the fewest sequences.

    The linear programme has a column for every pattern; those that lower the cost are
    made as the duals ask for them, by a knapsack. Each step is one pivot, and any step
    leaves a solution, so a bound on the steps costs at most a few sequences.
    """
    m = len(sizes)
    patterns = [np.eye(m, dtype=np.int64)[g] * (capacity // sizes[g]) for g in range(m)]
    inverse = np.diag([1 / (capacity // x) for x in sizes])
    amount = np.array(counts, float) / [capacity // x for x in sizes]
    for _ in range(40 * m + 40):
        worth, pattern = best_pattern(inverse.sum(0), sizes, capacity)
        if worth <= 1 + 1e-9:
            break
        change = inverse @ pattern
        ratio = np.full(m, np.inf)
        np.divide(amount, change, out=ratio, where=change > 1e-9)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * change, 0)
        amount[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        patterns[out] = pattern
    return list(zip(patterns, amount.tolist(), strict=True))


class _Pieces:
    """The pieces that have no place yet: how many of each length, and the next one's rank."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {k: n for k, n in histogram.items() if n}
        self.rank = dict.fromkeys(self.left, 0)
        self.lengths = sorted(self.left)

    def fitting(self, room: int, chosen: list[int]) -> int | None:
        """The largest length within the room of which more are left than are chosen."""
        k = bisect_right(self.lengths, room) - 1
        while k >= 0 and self.left[self.lengths[k]] <= chosen.count(self.lengths[k]):
            k -= 1
        return self.lengths[k] if k >= 0 else None

    def take(self, chosen: list[int], times: int, capacity: int) -> Run:
        """As many equal sequences of the chosen lengths as there are pieces for, at most times."""
        n = min(times, *(self.left[x] // chosen.count(x) for x in chosen))
        run = Run(n, capacity - sum(chosen))
        for x in chosen:
            run.items.append((x, self.rank[x]))
            self.rank[x] += n
            self.left[x] -= n
        for x in set(chosen):
            if not self.left[x]:
                self.lengths.remove(x)
        return run


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold every piece once."""
    limit = capacity // SMALL
    runs: list[Run] = []
    if histogram.get(capacity):
        runs.append(Run(histogram[capacity], 0, [(capacity, 0)]))
    large = {k: n for k, n in histogram.items() if limit < k < capacity}
    pieces, rounded = _Pieces(large), Counter()
    for part in grouped(large, groups):
        rounded[part[0][0]] += sum(n for _, _, n in part)
    sizes = list(rounded)
    found = configurations(sizes, list(rounded.values()), capacity) if sizes else []
    planned = sorted(([x for x, k in zip(sizes, pattern, strict=True) for _ in range(k)], math.floor(amount + 1e-6)) for pattern, amount in found)
    # A place takes the largest actual piece that fits, the last of a sequence all the room that is left. The pieces
    # left over still fit the places left over, largest to largest, since no place took a smaller one than it could.
    for places, times in reversed(planned):
        while times:
            chosen: list[int] = []
            for i, size in enumerate(places):
                room = capacity - sum(chosen) if i == len(places) - 1 else size
                chosen.append(pieces.fitting(room, chosen))
            if None in chosen:  # a rounding error planned one too many
                break
            runs.append(pieces.take(chosen, times, capacity))
            times -= runs[-1].count
    # what the fractions leave, less than a configuration a group, fills sequences by its actual lengths
    while pieces.lengths:
        first = pieces.lengths[-1]
        live = [x for x in reversed(pieces.lengths) if x <= capacity - first]
        used = best_fill(capacity - first, live, [pieces.left[x] - (x == first) for x in live])
        chosen = [first, *(live[i] for i in used)]
        runs.append(pieces.take(chosen, pieces.left[first], capacity))
    by_room: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def put(run: Run) -> None:
        if run.room not in by_room:
            by_room[run.room] = []
            insort(rooms, run.room)
        by_room[run.room].append(run)

    for run in runs:
        put(run)
    for length in sorted((k for k, n in histogram.items() if 0 < k <= limit and n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = next((r for r in rooms if r >= length), None)
            if room is None:
                per = capacity // length
                n = max(1, left // per)
                run = Run(n, capacity)
                for _ in range(min(per, left)):
                    run.items.append((length, rank))
                    rank, left, run.room = rank + n, left - n, run.room - length
                put(run)
                continue
            run = by_room[room].pop()
            if run.count > left:
                whole, run = run, run.split(left)
                put(whole)
            if not by_room[room]:
                del by_room[room]
                rooms.remove(room)
            run.items.append((length, rank))
            rank, left, run.room = rank + run.count, left - run.count, run.room - length
            put(run)
    return [run for room in rooms for run in by_room[room]]


def pack(docs: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS, **options) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    cut = keep(pieces(docs, capacity=capacity, **options), "pack-pieces")
    buckets = 16 + cut.count() // PIECES_A_BUCKET
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counted = keep(cut.groupBy("length", "bucket").count(), "pack-counts")
    histogram = {int(r[0]): int(r[1]) for r in counted.groupBy("length").agg(F.sum("count")).collect()}
    slots, base = [], 0
    for run in pack_histogram(histogram, capacity, groups):
        at = 0
        for length, rank in run.items:
            slots.append((length, rank, rank + run.count, base, at))
            at += length
        base += run.count
    plan = F.broadcast(spark.createDataFrame(slots, "length long, lo long, hi long, base long, offset long"))  # a few rows a length
    shift = counted.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("rank", rank).join(small(shift), ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    placed = ranked.join(plan, (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"]))
    return placed.select(
        *(ranked[c] for c in cut.columns if c != "bucket"), (plan["base"] + ranked["rank"] - plan["lo"]).alias("sequence_id"), plan["offset"]
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = None
