"""The pipeline's stages on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tallyworks.llm import pieces, pii, simhash

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small folder of documents and labels: good prose, junk, copies, personal data and odd rows."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        text = (" ".join(rng.choices(words, k=60)).capitalize() + ".") if good else "### $$$ %%% " * rng.randint(5, 20)
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(500, rows[1][1], "en", "s1", 1), (501, rows[2][1] + " mail a@b.co", "en", "s2", 1)]
    rows += [(1, rows[1][1], "en", "s1", len(rows[1][1])), (600, None, None, None, None), (601, "", "en", "s1", 0), (602, " ".join(rng.choices(words, k=40_000)) + ".", "en", None, 9)]
    rows += [(None, " ".join(rng.choices(words, k=50)) + " +1 202 555 0100.", "en", "s3", 1)]
    docs = spark.createDataFrame(rows, NAMES)
    docs.withColumns({c: docs["doc_id"] for c in ("fp", "size", "__key", "terms", "copies", "component_id")}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, folder)
        assert docs.columns[: len(names)] == names if k < len(corpus_pipeline.STAGES) - 1 else set(names) <= set(docs.columns)
        docs = corpus_pipeline.materialise(docs)
        after = docs.collect()
        seen.append((name, before, after))
    quality, copies, personal, mixed, encoded = seen
    kept = [r["doc_id"] for r in quality[2]]
    assert not any(r["text"] and "###" in r["text"] for r in quality[2]) and len([d for d in kept if d is not None and d < 240]) >= 175
    fps: dict = {}
    for r in copies[1]:
        if r["doc_id"] is not None:
            fps.setdefault(simhash.fingerprint(r["text"]), []).append(r["doc_id"])
    left = [r["doc_id"] for r in copies[2] if r["doc_id"] is not None]
    assert len(left) == len(set(left)) and 500 not in left and {min(ids) for ids in fps.values()} >= set(left)
    assert [r["doc_id"] for r in copies[2]].count(None) == [r["doc_id"] for r in copies[1]].count(None)
    assert len(personal[1]) == len(personal[2]) and not any(pii.base_spans(r["text"] or "") for r in personal[2])
    clean = {(r["doc_id"], r["text"]) for r in personal[1] if not pii.base_spans(r["text"] or "")}
    assert clean <= {(r["doc_id"], r["text"]) for r in personal[2]}
    times: dict = {}
    for r in mixed[2]:
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert max(times.values()) <= 3 and set(times) <= {(r["doc_id"], r["text"]) for r in mixed[1]}
    surface = pieces.Vocabulary.load().surface
    assert len(encoded[1]) == len(encoded[2]) and all(pieces.spelled(surface, r["ids"]) == r["text"] for r in encoded[2])


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []


def test_arrays_without_pieces(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in pieces.with_text(rows).collect()} == {1: None, 2: ""}
