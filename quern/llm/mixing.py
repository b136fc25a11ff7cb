"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is dealt by a hash of the row's id into a fixed number of blocks, so a
source that holds a third of all rows is many blocks. A source's target is met by
whole passes over its permuted blocks plus a first part of one more pass; the last
block of that part is cut at a row, and that row at a word. The block quotas of all
sources are exact. A binary tree splits them among the output shards: at each node a
multivariate-hypergeometric draw says how many blocks of each source go left (one draw
for each group of sources where all have a billion blocks or more). A leaf
draws its quota as the next blocks in the source's permuted order, which makes the
shards disjoint, and a hash orders the rows inside a shard.

The driver holds one row a source and one number a source and shard. The corpus is
read twice, its texts are never shuffled, and no window spans more than the blocks of
a source or the rows of one block.

Nulls: a null text has size 0, a null source is a source of its own that sorts last, a
null id is an id like any other. Rows of one id are taken alike; where the cut falls on
them they share its words, rounded down.
"""

from __future__ import annotations

import math
from itertools import cycle

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import as_long, keep, small, text_column, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCKS = 1024
SHARDS = 16
#: More sources than this are refused (never dropped): the driver plans them together.
MOST_SOURCES = 1_000_000
#: Blocks from which numpy's multivariate draw fails.
MOST_DRAWN = 1_000_000_000
BLANK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size; excess is shared again by weight."""
    found, left, active = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                found[i] = left * weights[i] / total
            break
        for i in over:
            found[i] = float(most * sizes[i])
        left -= sum(found[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return found


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[source] split exactly among shards: an array [shard, source]."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = np.zeros_like(quotas)
    for a, b in _drawable(quotas):
        group = quotas[a:b]
        n = int(group.sum()) * left // shards
        take[a:b] = n if b - a == 1 else rng.multivariate_hypergeometric(group, n, method="marginals")
    return np.vstack([splitting_tree(take, left, rng), splitting_tree(quotas - take, shards - left, rng)])


def _drawable(quotas: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of sources, each of one source or of fewer than MOST_DRAWN blocks: all of them if that is so."""
    if int(quotas.sum()) < MOST_DRAWN:
        return [(0, len(quotas))]
    starts, held = [0], 0
    for i, n in enumerate(quotas.tolist()):
        held += n
        if held >= MOST_DRAWN and i > starts[-1]:
            starts.append(i)
            held = n
    return list(zip(starts, [*starts[1:], len(quotas)], strict=True))


def _source_key(df: DataFrame, source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), df[source_col].cast("string")), F.lit("n"))


def draws(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST_REPEATS,
    blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 0,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, and mix_draws: an array of (shard, words), one for each time the mix takes the row."""
    spark = docs.sparkSession
    key = {
        "__mix_key": _source_key(docs, source_col),
        "__mix_block": F.pmod(F.xxhash64(as_long(docs, id_col), F.lit(seed)), F.lit(blocks)).cast("int"),
        "__mix_order": F.xxhash64(as_long(docs, id_col), F.lit(seed + 1)),
        "mix_size": word_count(text_column(docs, text_col)),
    }
    tagged = docs.withColumns(key)
    sizes = keep(tagged.select("__mix_key", docs[source_col].cast("string").alias("source"), "__mix_block", "__mix_order", as_long(docs, id_col).alias("id"), "mix_size"), "mix-sizes")
    per_block = keep(sizes.groupBy("__mix_key", "__mix_block").agg(F.sum("mix_size").alias("words")), "mix-blocks")
    sources = per_block.groupBy("__mix_key").agg(F.sum("words").alias("words"))
    if sources.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources cannot be planned together")
    # "s" + text sorts by code point; "n", the null source, goes last
    known = sorted(sources.collect(), key=lambda r: (r[0] == "n", r[0]))
    wanted = targets([r[1] for r in known], [w for w, _ in zip(cycle(weights), known, strict=False)], most)
    whole = [min(math.floor(t + 0.5), math.floor(most * r[1])) for t, r in zip(wanted, known, strict=True)]
    schema = T.StructType([T.StructField("__mix_key", T.StringType()), *(T.StructField(c, t) for c, t in (("total", T.LongType()), ("target", T.DoubleType()), ("passes", T.LongType()), ("rest", T.LongType())))])
    plan = spark.createDataFrame([(r[0], r[1], t, n // r[1] if r[1] else 0, n % r[1] if r[1] else 0) for r, t, n in zip(known, wanted, whole, strict=True)], schema)

    order = Window.partitionBy("__mix_key").orderBy(F.xxhash64("__mix_block", F.lit(seed + 2)), "__mix_block")
    upto = F.sum("words").over(order)
    cut = keep(
        per_block.join(plan, "__mix_key").withColumns({"at": F.row_number().over(order) - 1, "room": F.col("rest") - upto + F.col("words")})
        .withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("__mix_key")), "more": F.when(F.col("words") <= F.col("room"), F.lit("all")).when(F.col("room") > 0, F.lit("part")).otherwise(F.lit("none"))}),
        "mix-cuts",
    )
    # where in its block the last part of a pass ends: rows in hash order, one block a source
    edge = cut.where("more = 'part'").select("__mix_key", "__mix_block", "room")
    rows = sizes.join(small(edge), ["__mix_key", "__mix_block"]).groupBy("__mix_key", "__mix_block", "room", "__mix_order", "id").agg(F.sum("mix_size").alias("words"), F.count(F.lit(1)).alias("n"))
    before = F.sum("words").over(Window.partitionBy("__mix_key", "__mix_block").orderBy("__mix_order", F.col("id").asc_nulls_first())) - F.col("words")
    edge = rows.withColumn("left", F.col("room") - before).where("left > 0 AND left <= words").select(
        "__mix_key", "__mix_block", F.col("__mix_order").alias("__mix_cut_order"), F.col("id").alias("__mix_cut_id"), F.floor(F.col("left") / F.col("n")).alias("__mix_cut_words")
    )

    quotas = cut.groupBy("__mix_key").agg(F.max(F.col("passes") * F.col("n") + F.lit(0)).alias("full"), F.sum(F.when(F.col("more") != "none", 1).otherwise(0)).alias("extra")).collect()
    rng = np.random.default_rng(seed)
    by_key = {r[0]: r[1] + r[2] for r in quotas}
    leaves = splitting_tree(np.array([by_key.get(r[0], 0) for r in known], np.int64), shards, rng) if known else np.zeros((shards, 0), np.int64)
    ends = leaves.cumsum(0)
    ranges = [(known[s][0], shard, int(ends[shard, s] - leaves[shard, s]), int(ends[shard, s])) for shard in range(shards) for s in range(len(known)) if leaves[shard, s]]
    leaf = spark.createDataFrame(ranges, "__mix_key string, shard int, lo long, hi long")
    copies = F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("more") == "none", 1).otherwise(0))
    taken = (
        cut.where("passes > 0 OR more <> 'none'").select("__mix_key", "__mix_block", "more", "passes", "at", "n", F.explode(copies).alias("pass"))
        .withColumn("draw", F.col("pass") * F.col("n") + F.col("at"))
        .join(small(leaf), "__mix_key").where("draw >= lo AND draw < hi")
        .groupBy("__mix_key", "__mix_block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("__mix_draws"), F.first("passes").alias("__mix_passes"), F.first("more").alias("__mix_more"))
        .join(edge, ["__mix_key", "__mix_block"], "left")
    )
    taken = keep(taken, "mix-plan")
    out = tagged.join(small(taken), ["__mix_key", "__mix_block"], "left").join(small(plan.select("__mix_key", F.col("total").alias("mix_source_size"), F.col("target").alias("mix_target"))), "__mix_key", "left")
    at_cut = (F.col("__mix_order") == F.col("__mix_cut_order")) & as_long(docs, id_col).eqNullSafe(F.col("__mix_cut_id"))
    earlier = F.struct(F.col("__mix_order"), as_long(docs, id_col)) < F.struct(F.col("__mix_cut_order"), F.col("__mix_cut_id"))
    last = F.when(F.col("__mix_more") != "part", F.col("mix_size")).when(at_cut, F.col("__mix_cut_words")).when(earlier, F.col("mix_size")).otherwise(F.lit(0)).cast("long")
    every = F.transform("__mix_draws", lambda d: F.struct(d["shard"].alias("shard"), F.when(d["pass"] < F.col("__mix_passes"), F.col("mix_size")).otherwise(last).alias("words")))
    return out.withColumn("mix_draws", F.coalesce(F.filter(every, lambda d: d["words"] > 0), F.array().cast("array<struct<shard:int,words:bigint>>"))).select(
        *(docs[c] for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_draws")), "mix_size", "mix_source_size", "mix_target", "mix_draws"
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{BLANK}*{WORD}+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, **options) -> DataFrame:
    """One row for each time the mix takes a row of docs: its columns, the text cut where the mix takes a part of it, mix_shard, mix_order and mix_words.

    A shard in order of mix_order is locally shuffled; write_shards() lays it out so.
    """
    drawn = draws(docs, id_col=id_col, text_col=text_col, seed=seed, **options)
    out = drawn.select("*", F.posexplode("mix_draws").alias("__mix_copy", "__mix_draw"))
    text = F.when(F.col("__mix_draw.words") < F.col("mix_size"), first_words(F.col(text_col), F.col("__mix_draw.words"))).otherwise(F.col(text_col))
    added = {text_col: text, "mix_shard": F.col("__mix_draw.shard"), "mix_words": F.col("__mix_draw.words"), "mix_order": F.xxhash64(F.col(id_col), "__mix_copy", F.lit(seed + 3))}
    return out.withColumns(added).drop("mix_draws", "__mix_draw", "__mix_copy", "mix_size", "mix_source_size", "mix_target")


def write_shards(mixed: DataFrame, path: str, parts: int = 1) -> None:
    """Write shards as folders, each of `parts` files whose rows are in shuffled order."""
    part = F.pmod(F.xxhash64("mix_order"), F.lit(parts))
    mixed.withColumn("__part", part).repartition("mix_shard", "__part").sortWithinPartitions("mix_shard", "__part", "mix_order").drop("__part").write.partitionBy("mix_shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    drawn = draws(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return drawn.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"),
    )


SQL = None
