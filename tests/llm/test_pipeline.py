import collections

import compare
import pytest

import corpus_pipeline
from tremorline.llm import near_text, private_data
from tremorline.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The output of every stage, written and read again."""
    at = tmp_path_factory.mktemp("pipeline")
    docs, out = table(spark, compare.SF, "documents"), {"documents": None}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, compare.SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out[name] = docs
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_columns_and_take_effect(stages):
    docs = rows(stages["documents"])
    clean = rows(stages["toxicity"])
    assert set(clean) <= set(docs) and all(clean[i] == docs[i] for i in clean)
    single = rows(stages["near_duplicates"])
    classes = {r.doc_id: r.class_id for r in near_text.near_duplicates(stages["toxicity"]).collect()}
    assert set(single) == {i for i, c in classes.items() if i == c}
    hidden = rows(stages["private_data"])
    assert set(hidden) == set(single) and stages["private_data"].columns == stages["documents"].columns
    assert all(not private_data.base_spans(r.text) for r in hidden.values())
    mixed = collections.Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(mixed) <= set(hidden) and max(mixed.values()) <= 3
    packed = stages["packing"].groupBy("doc_id").agg({"piece": "max", "length": "sum"}).collect()
    assert {r.doc_id for r in packed} == set(mixed)


def test_run_equals_the_stages(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, compare.SF).select(key).collect())
    assert got == collections.Counter(tuple(r) for r in stages["packing"].select(key).collect())


def test_no_rows(spark, no_documents):
    docs = no_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, compare.SF)
        assert docs.count() == 0
        docs = no_documents.select("doc_id", "text", "lang", "source", "n_chars")
