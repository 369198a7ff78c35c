"""Personal data: disclosing terms against a slow count, and texts with very many spans."""

from __future__ import annotations

import math
import random
import re
import time

from tallyworks.llm import pii


def slow_terms(docs, alpha, support):
    """{doc_id: terms hidden in it} straight from the definition."""
    spans = {d: pii.base_spans(t or "") for d, t in docs}
    terms = {d: {x for x, *_ in pii.terms_outside(t or "", spans[d])} for d, t in docs}
    everywhere = {d: {x.lower() for x in re.findall(r"[^\W\d_]{2,}", t or "")} for d, t in docs}
    entities = {d: set(pii.entities_of(t or "", spans[d])) for d, t in docs}
    n = len(docs)
    out: dict = {}
    for e in set().union(*entities.values()):
        of = [d for d in entities if e in entities[d]]
        if len(of) < support:
            continue
        for t in set().union(*(terms[d] for d in of)):
            both = [d for d in of if t in terms[d]]
            n_term = sum(t in s for s in everywhere.values())
            if len(both) >= support and len(of) < n and math.log(min(1, len(both) / n_term) / (len(of) / n)) / -math.log(len(of) / n) >= alpha:
                for d in both:
                    out.setdefault(d, set()).add(t)
    return out


def test_disclosing_terms_equal_slow_count(spark):
    rng = random.Random(12)
    common, rare = [f"w{chr(97 + i)}" for i in range(20)], [f"zeta{chr(97 + i)}" for i in range(12)]
    docs = []
    for i in range(400):
        words = rng.choices(common, k=30)
        if i % 5 == 0:
            k = i // 5 % 12
            words += [f"name{k}@example.org", rare[k]] + ([rng.choice(rare)] if rng.random() < 0.2 else [])
        if i % 9 == 0:
            words.append("10.0.0.7")
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    docs += [(400, None), (401, ""), (402, "a" * 5000 + " name1@example.org")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    text = dict(docs)
    got = {r["doc_id"]: {text[r["doc_id"]][s["start"] : s["end"]].lower() for s in r["terms"]} for r in pii.sanitise(frame).collect()}
    want = slow_terms(docs, pii.ALPHA, pii.SUPPORT)
    assert len(want) > 50
    assert {d: t for d, t in got.items() if t} == want


def test_a_text_with_very_many_spans(spark):
    words = [f"user{i}@host{i % 7}.example.com call +1 202 555 {i % 10000:04d} at 10.0.{i % 256}.1," for i in range(50_000)]
    text = " ".join(words)
    began = time.perf_counter()
    got = pii.redact(spark.createDataFrame([(1, text), (2, "quiet")], "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 60
    out = {r["doc_id"]: r["text"] for r in got}
    assert out[2] == "quiet" and not pii.base_spans(out[1]) and out[1].count("[email]") == 50_000


def test_what_may_hold_personal_data(spark):
    """The filter without Python lets every text with spans through."""
    rng = random.Random(13)
    kinds = ["a@b.c", "+1 (2)34-567-89", "1.2.3.4", "4111 1111-1111 1111", "x@y", "12-3", "@.", "+"]
    docs = [(i, "".join(rng.choice([*kinds, " ", "9", "-"]) for _ in range(rng.randint(0, 12)))) for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in frame.where(frame.text.rlike(pii.MAYBE)).collect()}
    assert all(d in kept for d, t in docs if pii.base_spans(t))


def test_one_id_with_two_texts_and_repeated_rows(spark):
    docs = [(1, "a@b.co"), (1, "c@dd.co x"), (1, "a@b.co"), (None, "a@b.co"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in pii.digest(frame, pii.sanitise(frame)).collect())
    assert got == [(0, ""), (0, "email:0:6"), (1, "email:0:6"), (1, "email:0:6"), (1, "email:0:7")]
