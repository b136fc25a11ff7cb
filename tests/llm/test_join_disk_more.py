"""What the n-gram join leaves on disk: no shuffle files of written tables, two bytes a counted token, and few tokens in prefixes."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from quern.llm import ngram_join as J
from quern.llm.common import CLEAN, drop, keep


def _shuffles(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")
    return {b for b in blocks.split(",") if b.startswith("shuffle_")}


def test_a_kept_table_leaves_no_shuffle_files(spark):
    before, setting = _shuffles(spark), spark.conf.get(CLEAN)
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    kept = keep(counts, "test-clean")
    wait = time.time() + 10
    while _shuffles(spark) - before and time.time() < wait:
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert spark.conf.get(CLEAN) == setting
    assert kept.count() == 10 and counts.count() == 10  # the plan can run again
    drop(kept)


def test_counted_tokens_ship_in_two_bytes_and_come_back(spark):
    numbers = np.unique(np.random.default_rng(1).integers(0, 1 << (32 - J.SHIFT), 50_000))
    packed = J._gaps(numbers)
    assert (J._numbers(packed) == numbers).all() and len(packed) < 2.1 * len(numbers)
    for odd in ([], [0], [65534], [65535], [65536, 131071, 131072, 10_000_000], [0, 65535, 65536]):
        assert J._numbers(J._gaps(np.array(odd, np.int64))).tolist() == odd


def test_what_counts_as_common_grows_only_where_too_many_would_be(spark):
    texts = [" ".join(f"{kind}{i}" for i in range(12)) + f" own{n} a b c d" for kind, times in (("x", 40), ("y", 70), ("z", 150)) for n in range(times)]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, key long").repartition(1)
    usual = J.MOST_COMMON
    try:
        for most, least, held in ((10, 128, 8), (20, 64, 16), (1000, 32, 24)):  # 8 shingles a kind are common
            J.MOST_COMMON = most
            tokens, counts, _ = J.common_tokens(docs, 5, 8, 32)
            assert len(tokens) == held and counts.min() >= least
    finally:
        J.MOST_COMMON = usual


def test_the_threshold_does_not_follow_the_number_of_tokens(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(40))) for i in range(50)], "doc_id long, text string")
    seen, plain, usual = [], J.common_tokens, J.MOST_COMMON

    def spied(compared, size, buckets, least, own=None):
        seen.append(least)
        return plain(compared, size, buckets, least, own)

    J.common_tokens, J.MOST_COMMON = spied, 10  # 1800 tokens: it was 1800 // 10
    try:
        J.similar_groups(docs).count()
    finally:
        J.common_tokens, J.MOST_COMMON = plain, usual
    assert seen == [J.COMMON]
