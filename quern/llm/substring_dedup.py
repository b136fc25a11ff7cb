"""Removal of long repeated substrings with a run-length compressed index.

A byte goes if it lies in a string of `least` bytes that also starts earlier in the
corpus, by document id and then by position. All comparisons are of the input.

 1. Anchors. Every window of `least` bytes is assigned to the least of its k-mers under
    a hash order. The choice depends on the window alone, so equal windows have equal
    anchors at equal distances. Consecutive windows of one anchor are one occurrence:
    its context is all their bytes. A task marks the occurrences that repeat an earlier
    one of its own (same anchor, same context) and passes on only first ones, packed in
    arrays and dealt by the anchor's hash.
 2. Buckets. Occurrences with an equal context are copies: all but the earliest are
    marked whole. They are known by 128 bits, the hashes of anchor and context. An anchor
    that several contexts share makes these variants.
 3. Index. The variants' bytes are fetched, dealt by anchor again, and each bucket builds
    the run-length compressed Burrows-Wheeler transform of its variants with sampled run
    ends (run_index.py). The variants' positions are streamed through it; those whose
    matching statistics hang together with an earlier one at `least` bytes are marked.
    These matches are compared byte by byte.
 4. Marks go back to their documents, and are cut out.

An anchor that many different contexts share (a frequent line shorter than `least`) would
gather in one bucket; such anchors are found by a pass over all documents, and each of
their windows is an occurrence by itself, dealt by the hash of its own bytes and known by 128
bits. Which way an anchor goes changes no result, only where the work is done; so contexts are
counted by those of one hash in SAMPLED. There are at most MOST_FREQUENT such anchors.

Texts are shuffled only where the requests or the marks are too large to broadcast.

Nulls: a null text is empty. A null id sorts before all others. Rows that repeat an id
are one document to each other (none starts earlier), and each is cut alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytesets as B
from quern.llm.common import as_long, drop, keep, lean, text_column
from quern.llm.run_index import RunIndex

LEAST = 100
#: Windows of a text piece that share a choice of anchor: least - GAP + 1 is the k-mers' length.
GAP = 64
#: Bytes of text that a task holds occurrences of at once, and of a bucket of the first and second kind.
PART, BUCKET, INDEXED = 8 << 20, 12 << 20, 256 << 10
#: Contexts that make an anchor frequent, if the corpus has not so many that more than MOST_FREQUENT anchors could have them.
CONTEXTS, MOST_FREQUENT = 2000, 4_000_000
#: One in so many contexts is counted.
SAMPLED = 64
#: Bytes of requests or marks that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 64 << 20
#: A document is read in pieces of this many bytes, which overlap by a window.
PIECE = 1 << 18
_NULL = np.iinfo(np.int64).min
_LOW = np.uint64((1 << 24) - 1)


def _anchors(data: np.ndarray, offsets: np.ndarray, least: int):
    """Row, start, last start, anchor position, anchor hash and context hash of the occurrences of a block."""
    k = least - GAP + 1
    n = len(data)
    none = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    if n < least:
        return none
    sums = B.prefix_sums(data)
    hashes = B.mix((sums[k:] - sums[:-k]) * B.powers(n - k + 1, "down"))
    key = hashes & ~_LOW | np.arange(len(hashes), dtype=np.uint64)  # leftmost of equal k-mers
    width = 1
    while width < GAP:
        step = min(width, GAP - width)
        key = np.minimum(key[: len(key) - step], key[step:])
        width += step
    anchor = (key & _LOW).astype(np.int64)  # one for each window
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    inside = np.arange(len(anchor)) + least <= offsets[1:][row]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    new = np.r_[True, (anchor[start][1:] != anchor[start][:-1]) | (start[1:] != start[:-1] + 1)]
    first = start[new]
    last = start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
    at = anchor[first]
    context = B.span_hash(sums, first, last + least)
    context = B.mix(context ^ (at - first).astype(np.uint64) * B.MIX1)
    return row[first], first - offsets[row[first]], last - offsets[row[first]], at - offsets[row[first]], hashes[at], context


def _pieces(data: np.ndarray, offsets: np.ndarray, least: int):
    """Blocks of whole texts, and overlapping pieces of longer ones: first row, data, offsets, position of the first byte."""
    for i, j in B.blocks(offsets):
        a, b = offsets[i], offsets[j]
        if b - a <= PIECE:
            yield i, data[a:b], offsets[i : j + 1] - a, 0
        else:
            for start in range(0, int(b - a) - least + 1, PIECE):
                end = min(start + PIECE + least - 1, int(b - a))
                yield i, data[a + start : a + end], np.array([0, end - start]), start


def _occurrences(column: pa.Array, least: int):
    """Arrays of the occurrences of about PART bytes of text: row, start, last start, anchor, its hash, context hash."""
    data, offsets = B.text_bytes(column)
    for i, j in B.blocks(offsets, PART):
        found = []
        for first, piece, own, shift in _pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least):
            row, s, e, p, h, c = _anchors(piece, own, least)
            found.append((row + first + i, s + shift, e + shift, p + shift, h, c))
        yield [np.concatenate([f[x] for f in found]) for x in range(6)] if found else None, (data, offsets)


def frequent_anchors(texts: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of anchors that have many contexts in the corpus."""

    def count(batches):
        for batch in batches:
            for found, _ in _occurrences(batch.column(0), least):
                if found is None:
                    continue
                picked = found[5] >> np.uint64(32) < np.uint64(max(1, (1 << 32) // SAMPLED))
                pairs = np.unique(np.stack([found[4][picked], found[5][picked]], 1), axis=0).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hash", "context"])

    contexts = keep(texts.mapInArrow(lean(count), "hash long, context long").groupBy("hash", "context").count(), "repeat-contexts")
    by_anchor = contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    least_sampled = max(CONTEXTS // SAMPLED, 2, contexts.count() // MOST_FREQUENT)
    found = by_anchor.where(F.col("n") >= least_sampled).select("hash").toArrow()  # at most MOST_FREQUENT
    drop(contexts)
    return np.sort(found["hash"].to_numpy().astype(np.int64).view(np.uint64))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order of their starts, those that touch as one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]


def _mark_rows(doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Packed ranges for each document: (doc, hash, ranges)."""
    order = np.lexsort((start, text_hash, doc))
    doc, text_hash, start, end = doc[order], text_hash[order], start[order], end[order]
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]), True]) if len(doc) else np.zeros(1, int)
    return [(int(doc[a]), int(text_hash[a]), np.stack(_merged(start[a:b], end[a:b]), 1).astype("<i8").tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]


OUT = "bucket long, doc long, hash long, packed binary"
_NAMES = ["bucket", "doc", "hash", "packed"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=_NAMES)


_ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("s", "<i8"), ("n", "<u2"), ("a", "<u2")])


def _pack(entries: np.ndarray) -> bytes:
    """Column by column, the documents as runs: compact, and quick to read."""
    cut = np.flatnonzero(np.r_[True, (entries["doc"][1:] != entries["doc"][:-1]) | (entries["text"][1:] != entries["text"][:-1])])
    runs = np.diff(np.r_[cut, len(entries)]).astype("<u4")
    head = np.array([len(entries), len(cut)], "<i8")
    wide = np.array([entries["s"].max() >= 1 << 32], "<i8")
    places = entries["s"].astype("<i8" if wide[0] else "<u4")
    return b"".join(x.tobytes() for x in (head, wide, entries["doc"][cut], entries["text"][cut], runs, entries["h"], entries["c"], places, entries["n"].astype("<u1"), entries["a"].astype("<u1")))


def _unpack(blob: bytes) -> np.ndarray:
    n, d, wide = np.frombuffer(blob, "<i8", 3)
    at = 24
    out = np.empty(n, _ENTRY)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(blob, kind, count, at)
        at += found.nbytes
        return found

    doc, text, runs = take("<i8", d), take("<i8", d), take("<u4", d)
    out["doc"], out["text"] = np.repeat(doc, runs), np.repeat(text, runs)
    for name, kind in (("h", "<u8"), ("c", "<u8"), ("s", "<i8" if wide else "<u4"), ("n", "<u1"), ("a", "<u1")):
        out[name] = take(kind, n)
    return out


def _pack_requests(entries: np.ndarray) -> bytes:
    """Of a document's variants what it takes to fetch their bytes and deal them: a part of the anchor's hash, start, windows less one."""
    wide = np.array([entries["s"].max() >= 1 << 32], "<i8")
    key = (entries["h"] >> np.uint64(20) & np.uint64(0xFFFFFFFF)).astype("<u4")
    return b"".join(x.tobytes() for x in (wide, key, entries["s"].astype("<i8" if wide[0] else "<u4"), entries["n"].astype("<u1")))


def _unpack_requests(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = blob[0]
    n = (len(blob) - 8) // (13 if wide else 9)
    at = 8 + 4 * n
    return np.frombuffer(blob, "<u4", n, 8), np.frombuffer(blob, "<i8" if wide else "<u4", n, at).astype(np.int64), np.frombuffer(blob, "<u1", n, len(blob) - n).astype(np.int64)


def _by_bucket(entries: np.ndarray, buckets: int) -> list[tuple]:
    """Entries, in order of their documents, dealt by anchor."""
    where = ((entries["h"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 65536 else np.int64)
    order = np.argsort(where, kind="stable")
    entries, where = entries[order], where[order]
    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(where) else np.zeros(1, int)
    return [(int(where[a]), None, None, _pack(entries[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def _firsts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by anchor, context and place; of it the earliest of each context, and what repeats an earlier one."""
    if not len(e):
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    order = np.argsort(e["h"])
    h = e["h"][order]
    alone = np.r_[True, h[1:] != h[:-1]] & np.r_[h[1:] != h[:-1], True]
    several = order[~alone]
    part = e[several]
    order[~alone] = several[np.lexsort((part["s"], part["doc"], part["c"], part["h"]))]
    c, doc, s = e["c"][order], e["doc"][order], e["s"][order]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    later = (doc > doc[head]) | (s > s[head]) & (doc == doc[head])
    return order, ~later, later


def repeat_marks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, doc, hash, text), and packed ranges to cut from them: (doc, hash, packed)."""
    if not GAP < least < 256:
        raise ValueError(f"strings of {GAP + 1} to 255 bytes can be found")
    slim = docs.select(as_long(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    slim = slim.select("doc_id", F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), F.xxhash64("text").alias("hash"), "text")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET) + 8
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_anchors(slim.select("text"), least))

    def find(batches):
        common = frequent.value
        for batch in batches:
            doc, text_hash = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for found, (data, offsets) in _occurrences(batch.column(2), least):
                if found is None or not len(found[0]):
                    continue
                row, s, last, p, h, c = found
                if len(common):
                    hot = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                    if hot.any():  # each window by itself, known by its bytes
                        n = (last - s + 1)[hot]
                        each = np.repeat(s[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        rows = np.repeat(row[hot], n)
                        window, halves = np.empty(len(each), np.uint64), np.empty(len(each), np.uint64)
                        cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True])  # occurrences stand in order of their rows
                        for a, b in zip(cuts, cuts[1:], strict=False):
                            sums, at = B.prefix_sums(data[offsets[rows[a]] : offsets[rows[a] + 1]]), each[a:b]
                            window[a:b] = B.span_hash(sums, at, at + least)
                            halves[a:b] = B.mix(B.span_hash(sums, at, at + least // 2) * B.BASE + B.span_hash(sums, at + least // 2, at + least))
                        row, s, last, p, h, c = (np.r_[x[~hot], y] for x, y in ((row, rows), (s, each), (last, each), (p, each), (h, halves), (c, window)))
                e = np.empty(len(row), _ENTRY)
                e["h"], e["c"], e["doc"], e["text"], e["s"], e["n"], e["a"] = h, c, doc[row], text_hash[row], s, last - s, p - s
                order, first, later = _firsts(e)
                again, e = e[order[later]], e[np.sort(order[first])]
                # marks pass through any bucket, below zero
                rows = [(-1 - int(m[0]) % buckets, *m) for m in _mark_rows(again["doc"], again["text"], again["s"], again["s"] + again["n"] + least)]
                yield _batch(_by_bucket(e, buckets) + rows)

    def compare(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.set_column(0, "bucket", pa.array(np.full(table.num_rows, -1, np.int64)))
        e = np.concatenate([_unpack(b) for b in table["packed"].to_pylist()])
        order, first, later = _firsts(e)
        again, e = e[order[later]], e[order[first]]
        rows = [(-1, *m) for m in _mark_rows(again["doc"], again["text"], again["s"], again["s"] + again["n"] + least)]
        group = np.cumsum(np.r_[True, e["h"][1:] != e["h"][:-1]]) - 1
        differ = np.bincount(group[1:], (e["h"][1:] == e["h"][:-1]) & (e["c"][1:] != e["c"][:-1]), minlength=int(group[-1]) + 1)
        variant = e[differ[group] > 0]
        variant = variant[np.lexsort((variant["s"], variant["text"], variant["doc"]))]
        cuts = np.flatnonzero(np.r_[True, (variant["doc"][1:] != variant["doc"][:-1]) | (variant["text"][1:] != variant["text"][:-1]), True]) if len(variant) else np.zeros(1, int)
        rows += [(-2, int(v["doc"][0]), int(v["text"][0]), _pack_requests(v)) for v in (variant[a:b] for a, b in zip(cuts, cuts[1:], strict=False))]
        return pa.Table.from_batches([_batch(rows)]) if rows else pa.Table.from_batches([_batch([])])

    found = slim.select("doc", "hash", "text").mapInArrow(lean(find), OUT)
    judged = keep(found.groupBy("bucket").applyInArrow(lean(compare), OUT), "repeat-judged")
    wanted = judged.where("bucket = -2").groupBy("doc", "hash").agg(F.collect_list("packed").alias("packed"))
    wanted, size = _sized(wanted, "repeat-requests")
    second = int(size * 16 // INDEXED) + 8  # a request of about 10 bytes fetches about 160

    def fetch(batches):
        for batch in batches:
            out: dict[int, list] = {}
            for doc, text_hash, text, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for b in blobs:
                    for key, start, more in zip(*(x.tolist() for x in _unpack_requests(b)), strict=True):
                        out.setdefault(key % second, []).append((doc, text_hash, start, more + 1, raw[start : start + more + least]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, v in out.items() for _ in v], pa.int64()), *(pa.array([x[i] for v in out.values() for x in v], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                names=["bucket", "doc", "hash", "start", "windows", "bytes"],
            )

    def index(table: pa.Table) -> pa.Table:
        rows = sorted(set(zip(*(table[c].to_pylist() for c in ("doc", "start", "hash", "windows", "bytes")), strict=True)))
        found = RunIndex([r[4] for r in rows], least, [r[3] for r in rows]).repeated()
        who = np.repeat(np.arange(len(rows)), [len(f) for f in found])
        at = np.concatenate([np.empty(0, np.int64), *found])
        place = np.array([r[1] for r in rows], np.int64)[who] + at
        marks = _mark_rows(np.array([r[0] for r in rows], np.int64)[who], np.array([r[2] for r in rows], np.int64)[who], place, place + least)
        return pa.Table.from_batches([_batch([(-1, *m) for m in marks])])

    requests = slim.select("doc", "hash", "text").join(wanted, ["doc", "hash"]).select("doc", "hash", "text", "packed")
    indexed = keep(requests.mapInArrow(lean(fetch), "bucket long, doc long, hash long, start long, windows long, bytes binary").groupBy("bucket").applyInArrow(lean(index), OUT), "repeat-indexed")
    marks = judged.where("bucket = -1").unionByName(indexed)
    return slim, marks.groupBy("doc", "hash").agg(F.collect_list("packed").alias("packed"))


def _sized(packed: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A kept table of packed bytes with a broadcast hint if they are few, and their size."""
    kept = keep(packed, name)
    size = kept.agg(F.sum(F.aggregate("packed", F.lit(0), lambda n, b: n + F.length(b)) + 32)).first()[0] or 0
    return (F.broadcast(kept) if size <= MOST_BROADCAST else kept), int(size)


def cut(docs: DataFrame, *, least: int = LEAST, **options) -> DataFrame:
    """Every row's doc_id, n_bytes, the maximal ranges removed as spans, and the bytes kept."""
    slim, marks = repeat_marks(docs, least=least, **options)
    marks, _ = _sized(marks, "repeat-marks")

    def apply(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n, spans, kept = [], [], []
            for text, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                ranges = np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 2) for b in blobs]) if blobs else np.empty((0, 2), np.int64)
                ranges = ranges[np.argsort(ranges[:, 0])]
                merged = [(int(a), int(b)) for a, b in zip(*_merged(ranges[:, 0], ranges[:, 1]), strict=True)]
                left, at = [], 0
                for a, b in merged:
                    left.append(raw[at:a])
                    at = b
                n.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join([*left, raw[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = slim.join(marks, ["doc", "hash"], "left").select("doc_id", "text", "packed")
    return joined.mapInArrow(lean(apply), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest_of(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest_of(cut(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = None
