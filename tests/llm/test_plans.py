"""Plans that the driver holds at once stay small, however many steps an operator has."""

from __future__ import annotations

import re

import corpus_pipeline
from tallyworks.llm import mixing, pii

NAMES = "doc_id long, text string, source string"


def shuffles(df):
    """Shuffles of a frame's plan, those that are reused too."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_no_plan_of_the_mix_holds_its_earlier_steps(spark):
    docs = spark.createDataFrame([(i, "a b c d " * (i % 7), f"s{i % 3}") for i in range(60)], NAMES)
    mix = mixing.mix(docs)
    assert {name: shuffles(df) for name, df in mix.items() if name != "documents"} == {"schedule": 0, "pieces": 0, "sources": 0}
    assert shuffles(mix["documents"]) <= 6 and shuffles(mixing.mixed(docs)) <= 2


def python_calls(df):
    """Steps of a frame's plan that run in Python; those of one task each hold a worker of their own."""
    return len(re.findall("EvalPython|MapIn", df._jdf.queryExecution().executedPlan().toString()))


def test_a_task_of_the_pipeline_runs_one_python_worker(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = pii.scan(docs).where("size(pii) > 0").dropDuplicates(["doc_id"])
    assert python_calls(found) == 1
    calls = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        calls[name] = python_calls(out)
        docs = corpus_pipeline.materialise(out)
    assert calls == {"quality": 1, "near_duplicates": 0, "personal_data": 1, "mixing": 0, "pieces": 1}


def test_a_filtered_scan_finds_what_a_whole_one_does(spark):
    texts = ["a@b.co and 10.0.0.1", None, "", "quiet", "+1 202 555 0100, a@b.co", "a@b.co and 10.0.0.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["pii"]], r["entities"]) for r in pii.scan(docs).where("size(pii) > 0").collect()}
    want = {i: pii.base_spans(t or "") for i, t in enumerate(texts)}
    assert got == {i: (spans, pii.entities_of(texts[i], spans)) for i, spans in want.items() if spans} and set(got) == {0, 4, 5}
