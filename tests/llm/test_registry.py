"""The registered queries of this subpackage."""
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sparkraster.llm.registry import ORACLES, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ok, info = compare(spark, connect(SF), SF, name)
    assert ok, info


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        from sparkraster.session import cut_lineage
        docs = cut_lineage(stage(spark, docs, SF), "stage")
        assert docs.count() <= n
        n = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert "taken" in docs.columns and n > 0
