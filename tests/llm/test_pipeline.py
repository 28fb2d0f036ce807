import os

import corpus_pipeline as pipeline
import pytest

from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_fingerprint, plain_groups
from tests.llm.test_substrings import plain as plain_cuts

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_stages_follow_each_other(spark, docs):
    assert [name for name, _ in pipeline.STAGES] == [
        "toxicity", "near_duplicates", "repeated_passages", "source_mixing", "packing"
    ]
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.kept(stage(spark, before, SF_DIR), name)
        assert after.dtypes == docs.dtypes, name
        before = after
    packed = sorted(map(tuple, STAGES["packing"](spark, before, SF_DIR).drop("sequence_id", "offset").collect()))
    assert packed == sorted(map(tuple, pipeline.run(spark, SF_DIR).drop("sequence_id", "offset").collect()))
    check(STAGES["packing"](spark, before, SF_DIR).collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_toxicity_stage(spark, docs):
    left = STAGES["toxicity"](spark, docs, SF_DIR)
    gone = docs.count() - left.count()
    assert 0 < gone < 0.3 * docs.count()
    assert left.join(docs, docs.columns, "left_anti").count() == 0


def test_near_duplicate_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stay = {c for _, _, c in plain_groups([(i, plain_fingerprint(t)) for i, t in rows])}
    assert {r.doc_id for r in STAGES["near_duplicates"](spark, docs, SF_DIR).collect()} == stay


def test_passage_stage(spark, docs):
    rows = {r.doc_id: r for r in STAGES["repeated_passages"](spark, docs, SF_DIR).collect()}
    for doc_id, _, _, left in plain_cuts([(r.doc_id, r.text) for r in docs.collect()], 50):
        assert rows[doc_id].text == left.decode("utf-8", "ignore") and rows[doc_id].n_chars == len(rows[doc_id].text)


def test_mixing_stage(spark, docs):
    mixed = STAGES["source_mixing"](spark, docs, SF_DIR)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in docs.collect()}
    assert mixed.dropDuplicates(["doc_id"]).count() == docs.count() < mixed.count()


def test_odd_rows(spark, docs):
    """Nulls, repeated rows and an empty table go through all stages."""
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "some text", "en", "s", 9), (1, None, "en", "s", 0), (1, "a b c d", "en", "s", 7),
         (1, "a b c d", "en", "s", 7), (2, "", None, "s", 0)], docs.schema
    )
    for table in (docs.union(odd), docs.limit(0)):
        before = table
        for name, stage in pipeline.STAGES[:-1]:
            before = pipeline.kept(stage(spark, before, SF_DIR), name)
        check(STAGES["packing"](spark, before, SF_DIR).collect(), [(r.doc_id, r.text) for r in before.collect()])
