"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

from tallyworks.llm import langid, lines, media, middle, mixing, pieces, pii, quality, secrets, simhash, toxicity, vectors

ROWS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n", "en", None), (4, "one two three", "fr", "b"),
    (4, "one two three", "fr", "b"), (None, "some text of nobody a@b.co", None, "b"), (6, "word " * 30_000, "en", "a"),
    (7, "x" * 200_000, None, "a"), (8, "日本語 😀 é", "fr", None), (9, "1234 + @ . " * 5, "en", "c"),
]
SHAPE = "doc_id long, text string, lang string, source string"
EXTRA = ("score", "fp", "node", "size", "start", "near", "media", "ids", "held_out", "component", "target", "spans", "language")


def docs_of(spark, rows):
    docs = spark.createDataFrame(rows, SHAPE)
    return docs.withColumns({c: docs["doc_id"].cast("string") for c in EXTRA})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 4, 6, 8, 9)] + [(4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def works(labels):
    none = labels.limit(0)
    return {
        "quality": lambda d: quality.classify(d, labels), "quality without labels": lambda d: quality.classify(d, none),
        "toxicity": lambda d: toxicity.classify(d, labels), "toxicity without labels": lambda d: toxicity.classify(d, none),
        "simhash": simhash.near_duplicates, "language": langid.classify, "mix": lambda d: mixing.mix(d)["documents"],
        "pii": lambda d: pii.digest(d, pii.sanitise(d)), "redact": pii.redact, "secrets": secrets.find_secrets,
        "media": lambda d: media.with_fingerprint(media.with_media(d)), "pieces": pieces.with_pieces,
        "lines": lines.without_repeats, "middle": middle.with_middle,
    }


@pytest.mark.parametrize("name", sorted(works(type("L", (), {"limit": lambda *_: None})())))
def test_every_row_comes_back(spark, labels, name):
    work = works(labels)[name]
    got = work(docs_of(spark, ROWS)).collect()
    order = lambda ids: sorted(ids, key=lambda x: (x is None, x))
    assert order(r["doc_id"] for r in got) == order(r[0] for r in ROWS)
    assert work(docs_of(spark, [])).collect() == []


def test_defined_results(spark, labels):
    docs = docs_of(spark, ROWS)
    lang = {r["doc_id"]: r for r in langid.classify(docs).collect()}
    assert all(lang[i]["lang_pred"] == "und" and lang[i]["score"] == 0 for i in (1, 2, 3, 9))
    near = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert all(near[i]["fingerprint"] == "0" * 16 and near[i]["component_id"] == 1 for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in quality.classify(docs, labels).collect())
    left = sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect() if r["doc_id"] is not None)
    assert left == [1, 4, 6, 7, 8, 9]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
        (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(frame).collect()}
    assert got.pop(1) == (2, 1, True) and got.pop(2) == (2, 1, False) and got.pop(12) == (2, 1, False)
    assert all(g == (0, v, True) for v, g in got.items())
    assert vectors.near_duplicates(frame.limit(0)).collect() == []
