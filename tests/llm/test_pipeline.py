"""The pipeline's stages on awkward rows, on each other's results, and all queries with SQL."""

import pytest

import corpus_pipeline
from vacancyledger.llm import common, queries

from .sql import differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if sql))
def test_query_equals_sql(spark, name):
    plan, sql = queries.QUERIES[name]
    assert differences(plan(spark, SF_DIR), sql, SF_DIR) is None


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if not sql))
def test_query_runs(spark, name):
    assert queries.QUERIES[name][0](spark, SF_DIR).count() > 0


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    given, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, given, SF_DIR))
        seen.append((name, given.count(), out.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
            given = out
    counts = {n: (a, b) for n, a, b in seen}
    assert counts["quality classifier"][1] < counts["quality classifier"][0]
    assert counts["SimHash near-dedup"][1] < counts["SimHash near-dedup"][0]
    assert counts["PII"][0] == counts["PII"][1]
    assert corpus_pipeline.run(spark, SF_DIR).count() == seen[-1][2]


@pytest.mark.parametrize("position", range(4))
def test_stages_on_awkward_rows(spark, awkward, nothing, position):
    stage = corpus_pipeline.STAGES[position][1]
    for docs in (awkward, nothing):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.count() <= 3 * docs.count()


def test_last_stage_on_awkward_rows(spark, awkward, nothing):
    assert corpus_pipeline.pack_sequences(spark, awkward, SF_DIR).count() >= awkward.count()
    assert corpus_pipeline.pack_sequences(spark, nothing, SF_DIR).count() == 0


def test_temporary_tables_lie_in_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert common.shared_folder(spark).startswith(base.rstrip("/") + "/llm-")
