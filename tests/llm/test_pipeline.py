"""The pipeline over the smallest tables: each stage acts, keeps its columns, and leaves clean documents alone."""

from pathlib import Path

import pytest

import corpus_pipeline
from tabulens.llm.common import documents, written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


def test_stages(spark):
    docs = documents(spark, SF)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        if name != "tokens":
            assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()
        if name in ("pii", "tokens"):
            assert after.count() == docs.count()
        docs = after
    assert docs.filter("size(ids) <> n_tokens").isEmpty() and docs.count() < before
