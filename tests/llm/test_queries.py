"""The registered queries against their SQL, and the pipeline's stages against what they are to do."""

import pytest

import corpus_pipeline
from checks.compare import differences, duck
from cohortlens.llm.common import settle, table
from cohortlens.llm.registry import ORACLE, QUERIES
from cohortlens.llm.simhash import simhash_groups
from tests.llm.data import SF


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_returns_every_document(spark, name):
    assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == table(spark, SF, "documents").count()


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, SF), f"test-{name}")
        assert 0 < out.count()
        if name == "token_ids":
            assert out.count() == docs.count()
            break
        assert out.dtypes == docs.dtypes
        gone = docs.join(out, "doc_id", "left_anti")
        if name == "near_dedup":
            groups = simhash_groups(docs)
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in groups.collect()}
        if name == "decontamination":
            bad = QUERIES["op2_decontaminate"](spark, SF).filter("contaminated")
            assert gone.join(bad, "doc_id", "left_anti").count() == 0
            assert out.join(bad, "doc_id").count() == 0
        if name != "mixing":
            assert gone.count() < 0.4 * docs.count()
        docs = out
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
