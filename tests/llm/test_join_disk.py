"""What the n-gram join ships: no tokens of a single set, and no copies of a set where there are many."""

from __future__ import annotations

import random

import numpy as np

from quern.llm import ngram_join as J
from quern.llm.common import drop_kept


def _texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(50_000)}" for _ in range(60)) for _ in range(n)]


def test_the_filter_passes_what_two_sets_hold_and_little_else(spark):
    texts = _texts(400)
    near = [t + " more" for t in texts[:40]]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts + near)], "text string, key long").repartition(4)
    buckets = 64
    _, _, filters = J.common_tokens(docs, 5, buckets, 32)
    sets = list(J._sets(J.pa.array(texts + near), 5))
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    passed = J._repeated(J._ids(tokens, buckets), filters)
    assert passed[counts > 1].all()
    assert passed[counts == 1].mean() < 0.2


def test_copies_are_counted_and_compared_once(spark):
    texts = _texts(30)
    rows = [(copy * 1000 + i, t) for copy in range(12) for i, t in enumerate([*texts, texts[0] + " more"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    plain = J.common_tokens

    def counted(compared, size, buckets, least, own=None):
        seen.append(own)
        found = plain(compared, size, buckets, 1, own)
        seen.append(int(found[1].max()))
        return plain(compared, size, buckets, least, own)

    J.common_tokens = counted
    try:
        found = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in J.similar_groups(docs).collect()}
    finally:
        J.common_tokens = plain
        drop_kept(spark)
    assert seen[0] is not None and seen[1] == 2  # the first text and its near copy; each copy would count again
    assert found[5] == (5, 11) and found[11_005] == (5, 11)
    assert found[0] == (0, 23) and found[30] == (0, 23) and found[3030] == (0, 23)
