"""Quality scores from a generalised additive model with pairwise interactions.

Every whole text becomes a row of numbers (shares of symbols, capitals, repeated words
and lines, word and line lengths). Each number is binned at quantiles of the training
rows. Cyclic boosting visits the features in turn, round after round, and adds a
shallow tree over one feature's bins to that feature's lookup table; then the pairs of
features whose residuals interact most get two-way tables in the same way. A score is
the logistic of an intercept plus one table entry a feature and a pair: vectorised bin
additions, nothing else.

The model is fitted on the driver on at most `rows` labelled rows (those of smallest
hash); labels, language, source and id are never inputs. Everything is scored.

Nulls: a null text is empty, and empty texts get a score like any other. Labels that
are null or whose doc_id is null are not used; where an id has several labels the
largest counts. Without labels of both kinds each score is the share of label 1, or
0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytesets as B
from quern.llm.common import as_long, lean, text_column

#: Labelled rows that the model is fitted on, at most.
ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 64, 8, 10, 300, 100, 0.1

FEATURES = (
    "log_words", "mean_word", "sd_word", "capitals", "symbols", "exclamations", "pipes", "digits", "commas", "stops", "blanks", "non_ascii",
    "distinct_words", "top_word", "same_as_last", "most_repeats", "punctuated", "joined_symbols", "shingle_repeats", "line_repeats", "line_words", "longest_word",
)

_KIND = np.full(256, 11, np.uint8)  # symbols
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[ord("!")] = 4
_KIND[ord("|")] = 5
_KIND[[ord(","), ord(";"), ord(":")]] = 6
_KIND[[ord("."), ord("?")]] = 7
_KIND[[ord("'"), ord('"'), ord("-"), ord("("), ord(")")]] = 8
_KIND[128:192] = 9  # further bytes of a character
_KIND[192:256] = 10
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!|#$%&*@~^_=+<>/\\"]] = True
WINDOW = 50


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a block."""
    low = B.LOWER[data]
    starts, ends, first = B.words(low, offsets)
    sums = B.prefix_sums(low)
    hashes = B.span_hash(sums, starts, ends)
    lengths = (ends - starts).astype(float)
    odd = _PUNCT[data[ends - 1]] if len(ends) else np.empty(0, bool)
    full = (_KIND[data[ends - 1]] >= 6) & (_KIND[data[ends - 1]] <= 7) if len(ends) else odd
    kinds = _KIND[data]
    breaks = np.flatnonzero(data == 10)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for k in range(len(offsets) - 1):
        a, b, p, q = first[k], first[k + 1], offsets[k], offsets[k + 1]
        n = b - a
        if not n:
            continue
        c = np.bincount(kinds[p:q], minlength=12) / (q - p)
        letters = max(c[1] + c[2] + c[10], 1e-9)
        w, ln = hashes[a:b], lengths[a:b]
        _, counts = np.unique(w, return_counts=True)
        same = w[1:] == w[:-1]
        most = 0.0
        if n > 1:
            run = np.r_[0, np.cumsum(same)]
            span = min(WINDOW, n - 1)
            most = (run[span:] - run[:-span]).max() / span
        grams = 1.0
        if n >= 5:
            g = w[: n - 4].copy()
            for i in range(1, 5):
                g = g * B.BASE + w[i : n - 4 + i]
            grams = len(np.unique(g)) / len(g)
        inner = breaks[np.searchsorted(breaks, p) : np.searchsorted(breaks, q)]
        ls, le = np.r_[p, inner + 1], np.r_[inner, q]
        ls, le = ls[le > ls], le[le > ls]
        lines = 0.0
        if len(ls) > 1:
            _, at = np.unique(B.span_hash(sums, ls, le), return_index=True)
            lines = 1 - (le[at] - ls[at]).sum() / (le - ls).sum()
        out[k] = (
            np.log1p(n), ln.mean(), ln.std(), c[2] / letters, c[11] + c[5] + c[4], c[4], c[5], c[3], c[6], c[7], c[0], c[9],
            len(counts) / n, counts.max() / n, same.mean() if n > 1 else 0, most, full[a:b].mean(), odd[a:b].mean(), 1 - grams, lines, n / max(1, len(ls)), ln.max(),
        )
    return out


def text_features(column: pa.Array) -> np.ndarray:
    data, offsets = B.text_bytes(column)
    return np.vstack([np.zeros((0, len(FEATURES))), *(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in B.blocks(offsets))])


@dataclass
class Model:
    """An intercept, edges and table of each feature, and two-way tables of pairs."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
            for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-total))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = 3, damp: float = 1.0) -> np.ndarray:
    """A value for each bin: a regression tree over ordered bins, split greedily."""
    cuts = [(0, len(gradient))]

    def worth(g, h):
        return g * g / (h + damp)

    gs, hs = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(hessian)]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(cuts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = worth(gs[m] - gs[a], hs[m] - hs[a]) + worth(gs[b] - gs[m], hs[b] - hs[m]) - worth(gs[b] - gs[a], hs[b] - hs[a])
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], i, int(m[k]))
        if best[1] is None:
            break
        a, b = cuts.pop(best[1])
        cuts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in cuts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + damp)
    return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of one-way tables, then of the two-way tables whose residuals interact most."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))))
    model = Model(float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = residual()
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[f] += step
            total += step[b]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]
    g, h = residual()
    gains = []
    for f in range(x.shape[1]):
        for k in range(f + 1, x.shape[1]):
            cell = coarse[f] * size[k] + coarse[k]
            n = size[f] * size[k]
            gains.append((float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + 1)).sum()), f, k))
    for _, f, k in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:PAIRS]:
        model.pairs.append((f, k))
        model.pair_tables.append(np.zeros((size[f], size[k])))
    for _ in range(PAIR_ROUNDS):
        for (f, k), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = residual()
            gm, hm = (np.bincount(coarse[f] * size[k] + coarse[k], v, table.size).reshape(table.shape) for v in (g, h))
            # a tree of depth two: the best split of one feature, then trees over the other on either side
            cut = max(range(1, table.shape[0] + 1), key=lambda m: (gm[:m].sum() ** 2 / (hm[:m].sum() + 1) + gm[m:].sum() ** 2 / (hm[m:].sum() + 1), -m))
            step = np.zeros_like(table)
            for rows in (slice(0, cut), slice(cut, None)):
                step[rows] = _tree(gm[rows].sum(0), hm[rows].sum(0), 2)
            table += RATE * step
            total += RATE * step[coarse[f], coarse[k]]
    return model


def held_out(doc_id):
    """Rows whose labels are never learnt from: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS) -> Model:
    known = labels.select(as_long(labels, id_col).alias("__id"), labels[label_col].cast("double").alias("__y")).dropna()
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(as_long(docs, id_col).alias("__id"), text_column(docs, text_col).alias("__text"))
    schema = ", ".join(["id long", "y double", *(f"{f} double" for f in FEATURES)])

    def measure(batches):
        for batch in batches:
            x = text_features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in x.T)], names=["id", "y", *FEATURES])

    # of an id that several rows have the row of the least features counts, so the driver gets at most `rows` rows
    measured = texts.join(F.broadcast(known), "__id").select("__id", "__y", "__text").mapInArrow(lean(measure), schema)
    found = measured.groupBy("id").agg(F.min(F.struct("y", *FEATURES)).alias("x")).select("id", "x.*").toArrow()
    table = np.array([found.column(c).to_numpy() for c in ("id", "y", *FEATURES)]).T.astype(float)
    table = table[np.lexsort(table.T[::-1])]
    return fit(table[:, 2:], table[:, 1])


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with quality_score and quality_predicted."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    schema = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).schema.add("score", "double")

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(text_features(batch.column(0).field(text_col))))], names=["row", "score"])

    out = inner.mapInArrow(lean(score), schema)
    kept = [c for c in docs.columns if c not in ("quality_score", "quality_predicted")]
    return out.select(*(F.col(f"row.`{c}`") for c in kept), F.col("score").alias("quality_score"), (F.col("score") >= threshold).cast("int").alias("quality_predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    slim = docs.select("doc_id", text_column(docs).alias("text"))
    schema = "doc_id long, score double"

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(text_features(batch.column(1))))], names=["doc_id", "score"])

    return slim.mapInArrow(lean(score), schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL = None
