"""Passages under a budget against a plain version, on long texts with very many keywords."""

from __future__ import annotations

import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyworks.functions import passages, text


def slow(text, keywords, limit, head, radius):
    """A character at a time: which are kept, in order of the keywords."""
    if len(text) <= limit:
        return text
    kept = [i < head for i in range(len(text))]
    budget = limit - min(head, len(text))
    for k in keywords:
        for m in re.finditer(k, text, re.IGNORECASE):
            a, b = max(0, m.start() - radius), min(len(text), m.end() + radius)
            new = sum(not x for x in kept[a:b])
            # a stretch touches what is kept if a neighbour or any character of it is
            touches = any(kept[max(0, a - 1) : b + 1])
            cost = new + (0 if touches else len(passages.BETWEEN))
            if new and cost <= budget:
                kept[a:b] = [True] * (b - a)
                budget -= cost
    parts, now = [], ""
    for ch, k in zip(text, kept, strict=True):
        if k:
            now += ch
        elif now:
            parts, now = [*parts, now], ""
    return passages.BETWEEN.join([*parts, now] if now else parts)


@pytest.mark.parametrize(("limit", "head", "radius"), [(300, 60, 15), (120, 1, 7), (200, 500, 10), (5, 2, 1)])
def test_passages_equal_a_plain_version(spark, limit, head, radius):
    rng = random.Random(limit)
    rows = [(i, "".join(rng.choices(["fpl", "Charity", "apply", " ", "x", "é😀\n"], [1, 1, 2, 20, 60, 9], k=rng.randint(0, 900)))) for i in range(60)] + [(100, ""), (101, None), (102, "fpl " * 400)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("s", passages.spans_of("text", limit=limit, head=head, radius=radius))
    got = {r["id"]: r["y"] for r in docs.select("id", passages.selected(F.col("text"), F.col("s")).alias("y")).collect()}
    assert got == {i: None if t is None else slow(t, passages.KEYWORDS, limit, head, radius) for i, t in rows}


def test_a_keyword_in_every_line_of_a_long_text():
    text = "apply to the desk of charity\n" * 60_000
    began = time.perf_counter()
    spans = passages.chosen(text, [re.compile(k) for k in passages.KEYWORDS], passages.LIMIT, passages.HEAD, passages.RADIUS)
    assert time.perf_counter() - began < 2 and sum(b - a for a, b in spans) <= passages.LIMIT


def test_few_rows_of_a_batch_are_python_values(spark):
    pages = pa.array([f"<p>{i} " + "x" * 20_000 for i in range(2000)])
    tracemalloc.start()
    out = text.by_rows(text.page_text, pa.string(), pages, pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [p.as_py()[3:] for p in pages] and peak < 15_000_000
    assert text.by_rows(text.page_text, pa.string(), pages[:0], pages[:0]).to_pylist() == []


def test_ascii_is_in_compatible_form_and_other_texts_are_brought_into_it(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab c", "ﬁt Ａ", "", None])], "i int, t string")
    assert [r["x"] for r in rows.select("i", text.compatible(F.col("t")).alias("x")).sort("i").collect()] == ["ab c", "fit A", "", None]
