"""The pipeline's quality stage without enough labels for a model."""

from __future__ import annotations

import pytest

import corpus_pipeline

from . import cases


def test_too_few_labels_are_an_error(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(ValueError):
        corpus_pipeline.quality(spark, cases.docs(spark), str(tmp_path))
