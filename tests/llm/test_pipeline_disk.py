"""What the pipeline leaves on disk between its stages."""

from __future__ import annotations

import corpus_pipeline
from quern.llm import common


def test_a_stage_leaves_its_documents_and_no_other_table(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id long, text string")
    own = common.keep(docs, "test-own")
    before, seen = common.kept_paths(), []

    def stage(spark_, rows, sf_dir):
        seen.append(common.kept_paths() - before)
        common.keep(rows, "test-inner")
        return rows.where("doc_id >= 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage), ("last", lambda s, rows, d: (seen.append(common.kept_paths() - before), rows)[1])])
    path = f"{common.shared_dir(spark)}/test-pipeline-{id(seen)}"
    docs.write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == 20
    assert [len(s) for s in seen] == [0, 1, 1, 1]
    assert own.count() == 20
    common.drop(own)
