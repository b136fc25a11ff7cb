"""Exact dedup by its definition, and the pipeline stage by stage against plain versions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import exact_dedup, mixing, packing, quality
from tests.llm.test_brute_force import corpus, shingle_set

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("options", [{}, {"block_bytes": 7}, {"block_bytes": 7, "digest": lambda b: F.substring(b, 1, 1)}])
def test_exact_dedup(spark, options):
    """Blocks of seven bytes need many levels; a one-byte digest makes distinct blocks share one."""
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["ab", "AB", "É", "é", "ßx"]) for _ in range(rng.choice([0, 1, 2, 3, 3, 3, 40])))) for i in range(200)]
    found = {r["doc_id"]: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(t.translate(LOWER), []).append(i)
    for t, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for i, t in corpus(3, 150):
        bad = rng.random() < 0.2
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t, "en", rng.choice(["a", "b", "b", None]), len(t), int(not bad)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[5], 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    stage = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, stage[-1], str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        stage.append(spark.read.parquet(f"{tmp_path}/stage{k}"))
    got = [s.collect() for s in stage[1:]]

    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    accepted = {r["doc_id"] for r in quality.scored(docs, model).collect() if r["quality_score"] >= 0.5}
    assert {r["doc_id"] for r in got[0]} == accepted and 0 < len(accepted) < len(rows)
    held = [(r[0], r[5]) for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum((i in accepted) == bool(q) for i, q in held) >= 0.9 * len(held)

    last: dict[str, int] = {}
    for r in got[0]:
        key = r["text"].translate(LOWER)
        last[key] = max(last.get(key, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in got[1]} == set(last.values()) and len(got[1]) == len(last)

    sets = {r["doc_id"]: shingle_set(r["text"]) for r in got[1]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r["doc_id"] for r in got[2]} == {i for i in sets if root(i) == i}

    size = {r["doc_id"]: len(r["text"].split()) for r in got[2]}
    sources = sorted({r["source"] for r in got[2] if r["source"]}) + [None]
    total = [sum(size[r["doc_id"]] for r in got[2] if r["source"] == s) for s in sources]
    for s, want in zip(sources, mixing.targets(total, [5, 2, 1]), strict=True):
        assert abs(sum(len(r["text"].split()) for r in got[3] if r["source"] == s) - want) <= 1
    assert all(r["n_chars"] == len(r["text"]) for r in got[3])

    encode = packing.encoder(packing.default_vocabulary())
    assert sum(p["length"] for p in got[4]) == sum(len(x) + 1 for x in encode([r["text"] for r in got[3]]))
    room: dict[int, int] = {}
    for p in got[4]:
        room[p["sequence_id"]] = room.get(p["sequence_id"], 0) + p["length"]
    assert max(room.values()) <= 1024
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted((p["doc_id"], p["piece"], p["ids_crc32"]) for p in got[4])


def test_hot_keys(spark, monkeypatch):
    """Results are the same when nearly every key counts as hot."""
    from quern.llm import common, ngram_join

    rows = corpus(21, 120) + [(5000 + i, "one text that very many rows have in common") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def both():
        return sorted(map(tuple, exact_dedup.exact_groups(docs).collect())), sorted(map(tuple, ngram_join.similar_groups(docs).collect()))

    usual = both()
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert both() == usual
