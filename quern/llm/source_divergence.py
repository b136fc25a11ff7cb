"""How each source's words differ from the other sources' and from its language's: sort-based streaming.

Documents are counted in map tasks, one run a flush of a bounded table, so a word, source
or language that a third of all rows hold is shuffled as one row a flush and not one a
document. Runs are repartitioned and sorted by the key of lang, term and source, the documents of a run
being already merged, and a run-length scan adds them up. A second sort by term, lang and
source streams whole terms (the term leads, so that a comparison ends at its first bytes): the scan adds up document frequencies, keeps the terms that
enough documents have, and then emits, a run at a time, partial sums for pairs of sources.

A pair's sum over all V kept terms never visits the terms that neither source has. With
z the share of a term that a source lacks,

    sum f(p_a, p_b) = sum over a's terms f(p_a, z_b) + sum over b's terms f(z_a, p_b)
                    + (V - n_a - n_b) f(z_a, z_b) + sum over shared terms of the rest,

where the first two go by the histogram of a source's shares, and only the last needs runs:
a term of k sources adds k * k / 2 numbers to a matrix that its task holds, not to rows.

Nulls in text, lang and source are empty strings. Every row is a document, repeated rows and
rows of one id too. A text without terms still makes its group. Ties rank by the UTF-8 bytes
of the item. No rows give none.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import drop, join_hot, keep, lean, small

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Runs that a map task holds before it merges them; a half of them left, it hands them on.
HELD = 2_000_000
#: Bytes of texts that are counted at a time, and of a long text that are split into words at a time.
CHUNK, PIECE = 8 << 20, 1 << 20
#: Sources whose pairs a task sums in one matrix, and pairs that it adds at a time.
SIDE, PAIRS = 1024, 500_000
#: What a byte of UTF-8 counts as: letters in lower case, all of a non-ASCII character, or a blank.
AS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A run's key is its term, a zero byte (no term has one) and its group: the length of lang, lang, source.
RUN = "key binary, df long, n long"
COUNTED = "lang binary, term binary, source binary, df long, n long"


def group(lang: bytes, source: bytes) -> bytes:
    return len(lang).to_bytes(4, "big") + lang + source


def words(text: bytes):
    """Lists of the terms of a text, a bounded piece of it at a time."""
    data = text.translate(AS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if len(data) > at + PIECE else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(texts: list[bytes], own: list[bytes]) -> pa.Table:
    """Runs of the documents of a chunk, given as their terms between blanks, with their groups."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    terms = words.flatten().dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    some = code != pc.index(terms.dictionary, "").as_py()
    held, times = np.unique(code[some] * len(texts) + doc[some], return_counts=True)  # a term of a document
    groups, place = np.unique(np.array(own, object), return_inverse=True)
    run, of = np.unique(held // len(texts) * len(groups) + place[held % len(texts)], return_inverse=True)
    term = terms.dictionary.take(pa.array(run // len(groups))).view(pa.binary())
    end = pa.array([b"\0" + g for g in groups], pa.binary()).take(pa.array(run % len(groups)))
    df, n = np.bincount(of, minlength=len(run)), np.bincount(of, times, len(run)).astype(np.int64)  # below 2^53 in a chunk
    return pa.table({"key": pc.binary_join_element_wise(term, end, b""), "df": df, "n": n})


def count_terms(batches):
    """Runs of the documents' terms by lang and source, merged whenever many are held and handed on when they stay many."""
    held: list[pa.Table] = []
    texts, own, size = [], [], 0

    def merge():
        sums = pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("df", "sum"), ("n", "sum")])
        held[:] = [sums.select(["key", "df_sum", "n_sum"]).rename_columns(["key", "df", "n"])]

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(text) > PIECE:  # counted by itself, a piece at a time
                counts: Counter = Counter()
                for found in words(text):
                    counts.update(found)
                end = b"\0" + group(lang, source)
                held.append(pa.table({"key": pa.array([t + end for t in counts], pa.binary()), "df": pa.array([1] * len(counts), pa.int64()), "n": pa.array(counts.values(), pa.int64())}))
                continue
            texts.append(text.translate(AS))
            own.append(group(lang, source))
            size += len(text)
            if size >= CHUNK:
                held.append(_counted(texts, own))
                texts, own, size = [], [], 0
        if sum(t.num_rows for t in held) >= HELD:
            merge()
            if held[0].num_rows >= HELD // 2:
                yield from held[0].to_batches(max_chunksize=20_000)
                held = []
    if texts:
        held.append(_counted(texts, own))
    if held:
        merge()
        yield from held[0].to_batches(max_chunksize=20_000)


def _starts(batch, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row starts a run."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for key in keys:
        c = batch.column(key)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _unpacked(keys: pa.Array, df: np.ndarray, n: np.ndarray):
    """Rows of COUNTED: a run's key taken apart, its group once for each group there is."""
    parts = pc.split_pattern(keys, pattern=b"\0", max_splits=1).flatten()
    terms = parts.take(pa.array(np.arange(0, len(parts), 2)))
    groups = parts.take(pa.array(np.arange(1, len(parts), 2))).dictionary_encode()
    own = [(g[4 : 4 + int.from_bytes(g[:4], "big")], g[4 + int.from_bytes(g[:4], "big") :]) for g in groups.dictionary.to_pylist()]
    lang, source = (pa.array([g[k] for g in own], pa.binary()).take(groups.indices) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, terms, source, pa.array(df), pa.array(n)], names=["lang", "term", "source", "df", "n"])


def add_runs(batches):
    """One row a run of sorted keys, with the sums of df and n."""
    held = None  # the run that may go on in the next batch: key, df, n
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, at = batch.column("key"), _starts(batch, ["key"])
        sums = [np.add.reduceat(batch.column(c).to_numpy(), at) for c in ("df", "n")]
        if held and held[0] == keys[0].as_py():
            for total, more in zip(sums, held[1:], strict=True):
                total[0] += more
        elif held:
            yield _unpacked(pa.array([held[0]], pa.binary()), *(np.array([x]) for x in held[1:]))
        if len(at) > 1:
            yield _unpacked(keys.take(pa.array(at[:-1])), sums[0][:-1], sums[1][:-1])
        held = (keys[int(at[-1])].as_py(), int(sums[0][-1]), int(sums[1][-1]))
    if held:
        yield _unpacked(pa.array([held[0]], pa.binary()), *(np.array([x]) for x in held[1:]))


def whole_terms(batches):
    """Tables of sorted rows that begin and end with a (lang, term), and where its runs start."""
    left: list = []  # batches of the term that may go on
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _starts(batch, ["lang", "term"])
        first = (batch.column("lang")[0].as_py(), batch.column("term")[0].as_py())
        if left and (last != first or len(at) > 1):
            end = int(at[1]) if last == first else 0
            table = pa.Table.from_batches([*left, batch.slice(0, end)]).combine_chunks().to_batches()[0]
            yield table, np.zeros(1, np.int64)
            batch, left, at = batch.slice(end), [], at[at >= end] - end
        if not left and len(at) > 1:
            yield batch.slice(0, int(at[-1])), at[:-1]
            batch = batch.slice(int(at[-1]))
        left.append(batch)
        last = (batch.column("lang")[0].as_py(), batch.column("term")[0].as_py())
    if left:
        yield pa.Table.from_batches(left).combine_chunks().to_batches()[0], np.zeros(1, np.int64)


def keep_terms(least: int):
    """Runs of the terms that at least so many documents have; `total` is the term's count, `head` 1 in one row a term."""

    def run(batches):
        for table, at in whole_terms(batches):
            sizes = np.diff(np.r_[at, table.num_rows])
            enough = np.add.reduceat(table.column("df").to_numpy(), at) >= least
            total = np.repeat(np.add.reduceat(table.column("n").to_numpy(), at), sizes)
            head = np.zeros(table.num_rows, np.int64)
            head[at] = 1
            pick = pa.array(np.repeat(enough, sizes))
            columns = [*table.select(["lang", "term", "source", "n"]).columns, pa.array(total), pa.array(head)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "n", "total", "head"]).filter(pick)

    return run


def distance(p, q):
    """floor((p - q)^2 / (p + q)) of scaled shares; the square is at most 10^18."""
    return (p - q) * (p - q) // (p + q)


def shared_pairs(batches):
    """Partial sums, for pairs of sources that share terms, of what the terms add to the sum of single sources; both ways.

    One matrix of SIDE groups at most is held, and handed on when more come.
    """
    index: dict[tuple[bytes, bytes], int] = {}
    sums = np.zeros((SIDE, SIDE), np.int64)

    def flush():
        names = list(index)
        i, j = np.nonzero(sums)
        yield _pairs(names, i, j, sums[i, j])
        index.clear()
        sums[:] = 0

    for table, at in whole_terms(batches):
        lang, source = (table.column(c).dictionary_encode() for c in ("lang", "source"))
        codes, row = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        names = [(lang.dictionary[c // len(source.dictionary)].as_py(), source.dictionary[c % len(source.dictionary)].as_py()) for c in codes.tolist()]
        if len({*index, *names}) > SIDE:
            yield from flush()
        if few := len(names) <= SIDE:
            where = np.array([index.setdefault(name, len(index)) for name in names])[row]
        share, absent = (table.column(c).to_numpy() for c in ("p", "z"))
        rows = np.arange(table.num_rows)
        after = np.repeat(np.r_[at[1:], table.num_rows], np.diff(np.r_[at, table.num_rows])) - 1 - rows  # partners of a row: the rest of its run
        before = np.r_[0, np.cumsum(after)]
        a = 0
        while a < len(rows):  # rows with so many pairs together
            b = max(a + 1, int(np.searchsorted(before, before[a] + PAIRS, "right")) - 1)
            x = np.repeat(rows[a:b], after[a:b])
            y = x + 1 + np.arange(len(x)) - np.repeat(before[a:b] - before[a], after[a:b])
            p, q, z, w = share[x], share[y], absent[x], absent[y]
            value = distance(p, q) - distance(p, w) - distance(z, q) + distance(z, w)
            if few:
                np.add.at(sums, (where[x], where[y]), value)
            else:
                pair, of = np.unique(row[x] * len(names) + row[y], return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, of, value)
                yield _pairs(names, pair // len(names), pair % len(names), total)
            a = b
    yield from flush()


def _pairs(names, i, j, value):
    """Sums of pairs as rows of either source."""
    a, b = np.r_[i, j], np.r_[j, i]
    columns = [[names[k][0] for k in a], [names[k][1] for k in a], [names[k][1] for k in b]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns), pa.array(np.r_[value, value])], names=["lang", "source", "item", "value"])


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; null without terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")) + 1)


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Sources ranked by divergence from each other source of their language, and each source's most telling terms."""
    keys, order = ["lang", "term", "source"], ["term", "lang", "source"]
    slim = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary").alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counted = slim.mapInArrow(lean(count_terms), RUN).repartition("key").sortWithinPartitions("key").mapInArrow(lean(add_runs), COUNTED)
    kept = keep(
        counted.repartition("lang", "term").sortWithinPartitions(*order).mapInArrow(lean(keep_terms(least)), "lang binary, term binary, source binary, n long, total long, head long"),
        "divergence-terms",
    )
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("terms"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"), F.count(F.lit(1)).alias("own"))
    every = slim.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(small(langs), ["lang"], "left").na.fill(0)
    groups = keep(every.withColumn("z", _share(F.lit(0), F.col("group_total"), F.col("terms"))), "divergence-groups")

    rows = kept.count()
    shares = join_hot(kept, groups, ["lang", "source"], "own", rows)
    shares = keep(shares.select(*keys, _share(F.col("n"), F.col("group_total"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"), "z"), "divergence-shares")
    drop(kept)

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("z").alias("item_z"))
    between = (F.col("terms") - F.col("own") - F.col("item_own")) * _distance(F.col("z"), F.col("item_z"))
    neither = groups.join(small(other), "lang").where("source <> item").select("lang", "source", "item", F.coalesce(between, F.lit(0)).alias("value"))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c"))
    single = histogram.join(small(other), "lang").where("source <> item").select("lang", "source", "item", (F.col("c") * _distance(F.col("p"), F.col("item_z"))).alias("value"))
    both = shares.repartition("lang", "term").sortWithinPartitions(*order).mapInArrow(lean(shared_pairs), "lang binary, source binary, item binary, value long")
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    single = single.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", sides.alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")
    pairs = neither.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    out = pairs.withColumn("part", F.lit("pair")).unionByName(telling.withColumn("part", F.lit("term")))
    return out.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")), "value", F.col("rank").cast("int").alias("rank"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), words as (
  select id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs
), vocabulary as (
  select lang, term from words group by lang, term having count(distinct id) >= 10
), counts as (
  select lang, source, term, count(*) as n from words semi join vocabulary using (lang, term) group by all
), sizes as (
  select g.lang, g.source, (select count(*) from vocabulary v where v.lang = g.lang) as v,
         (select coalesce(sum(n), 0) from counts c where c.lang = g.lang and c.source = g.source) as total,
         (select coalesce(sum(n), 0) from counts c where c.lang = g.lang) as lang_total
  from (select distinct lang, source from docs) g
), shares as (
  select s.lang, s.source, t.term, coalesce(c.n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) as p,
         1 + (1000000000::hugeint * (l.n + 2)) // (s.lang_total + 2 * s.v) as q
  from sizes s join vocabulary t on t.lang = s.lang
  join (select lang, term, sum(n) as n from counts group by all) l on l.lang = t.lang and l.term = t.term
  left join counts c on c.lang = s.lang and c.source = s.source and c.term = t.term
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item,
         coalesce((select sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) from shares x join shares y on x.lang = y.lang and x.term = y.term
                   where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from sizes a join sizes b on a.lang = b.lang and a.source <> b.source
), terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from shares where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms)
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""
