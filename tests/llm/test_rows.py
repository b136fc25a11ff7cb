"""Rows that repeat ids, hot blocks, clashing columns, empty stages, and the additive model against a slow one."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import common, exact_dedup, mixing, ngram_join, quality

A = [f"word{i}" for i in range(60)]
B = [f"other{i}" for i in range(60)]


def near(words, k):
    return " ".join([*words[:k], "changed", *words[k + 1 :]])


def test_near_copies_go_by_row(spark):
    """A unique text stays whatever its id's other rows are, and a near copy without an id goes."""
    rows = [(1, " ".join(A), "en", "a", 0), (5, near(A, 3), "en", "a", 0), (5, " ".join(B), "en", "a", 0), (None, near(A, 40), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, " ".join(A)), (5, " ".join(B))]
    groups = {(r["doc_id"], r["hash"]): r for r in ngram_join.row_groups(docs).collect()}
    assert sorted((str(r["doc_id"]), r["component_id"], r["first"], r["n_links"]) for r in groups.values()) == [("1", 1, True, 2), ("5", 1, False, 1), ("5", 5, True, 0), ("None", 1, False, 1)]


def test_chains_and_groups_in_small_blocks(spark, monkeypatch):
    """A chain of similar neighbours is one component though its ends share nothing, in blocks of any size."""
    chain = [(i, " ".join(f"w{j}" for j in range(5 * i, 5 * i + 60))) for i in range(40)]
    group = [(100 + i, near(B, i)) for i in range(12)]
    docs = spark.createDataFrame(chain + group, "doc_id long, text string").repartition(3)
    plain = sorted(map(tuple, ngram_join.similar_groups(docs).collect()))
    assert {r[2] for r in plain if r[0] < 100} == {0} and {r[2] for r in plain if r[0] >= 100} == {100}
    monkeypatch.setattr(ngram_join, "MOST_PAIRED", 3)
    monkeypatch.setattr(ngram_join, "TOKENS_A_CELL", 200)
    assert sorted(map(tuple, ngram_join.similar_groups(docs, cell=4, common=2).collect())) == plain


def test_hot_blocks_and_pairs(spark, monkeypatch):
    """Blocks and pairs that most rows share are named by a broadcast, with the same groups."""
    rows = [(i, "shared block one" * 3 + str(i % 7) * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def found():
        return sorted(map(tuple, exact_dedup.exact_groups(docs, block_bytes=8).collect()))

    plain = found()
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    assert found() == plain


def test_mixing_keeps_clashing_columns(spark):
    names = ["cut_id", "cut_order", "mix_copy", "words", "row", "left", "n", "at", "pass"]
    docs = spark.createDataFrame([(i, "a b c d", "s", *names) for i in range(20)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    mixed = mixing.mix(docs)
    assert [r["cut_id"] for r in mixed.collect()] == ["cut_id"] * mixed.count() and set(names) <= set(mixed.columns)
    assert mixing.draws(docs).columns[: len(docs.columns)] == docs.columns


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, tmp_path, k):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_stages_of_hard_rows(spark, tmp_path):
    """Nulls, blanks, repeated rows and a long text pass through every stage."""
    rows = [(1, None, None, None, 0), (None, "", "en", "a", 0), (2, " \n ", "en", None, 3), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (4, " ".join(A) * 300, "en", "b", 0), (5, " " * 300_000, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes = [f(spark, docs, str(tmp_path)).count() for _, f in corpus_pipeline.STAGES]
    assert sizes[1] == 5 and sizes[2] == 7 and sizes[4] >= 7


def test_scores_are_sums_of_tables():
    """score() and the first boosting steps of fit() against plain loops."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept
        for f in range(3):
            total += model.tables[f][sum(e <= row[f] for e in model.edges[f])]
        for (f, g), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(e <= row[f] for e in model.pair_edges[f]), sum(e <= row[g] for e in model.pair_edges[g])]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


def test_trees_split_best():
    """The first split of a tree is the best of all splits, and leaves have their damped means."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9)
        worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        gains = [worth(0, m) + worth(m, 9) - worth(0, 9) for m in range(1, 9)]
        tree = quality._tree(g, h, 2)
        m = int(np.argmax(gains)) + 1 if max(gains) > 1e-9 else 9  # a split that gains nothing is not made
        assert tree == pytest.approx(np.r_[np.full(m, g[:m].sum() / (h[:m].sum() + 1)), np.full(9 - m, g[m:].sum() / (h[m:].sum() + 1))])


def test_many_labels_of_one_row_are_one(spark):
    docs = spark.createDataFrame([(0, f"text {i}") for i in range(50)] + [(i, "a b c") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert 0 <= quality.train(docs, labels, rows=10).score(np.zeros((1, len(quality.FEATURES))))[0] <= 1


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_kept_tables_are_deleted(spark):
    table = common.keep(spark.range(3).toDF("x"), "test-kept")
    path = table.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert os.path.isdir(path)
    common.drop(table)
    assert not os.path.isdir(path)


def test_entry_without_the_operators(tmp_path):
    """Without both folders the rest imports and has its queries."""
    import shutil

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("quern", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", f"{tmp_path}/{name}")
    shutil.rmtree(tmp_path / "quern" / "llm")
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120).stdout
    names, sql = json.loads(out.strip().splitlines()[-1])
    assert "bm25_topk" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")] and set(sql) <= set(names)
