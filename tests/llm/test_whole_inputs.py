"""Disclosure and language counts over whole inputs, against slow versions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np

from tallyworks.llm import langid, pii


def test_terms_are_counted_and_hidden_in_whole_documents(spark):
    gap = "one two three four five six seven eight"
    rows = [(i, f"Zorblatt {gap} zed@example.org {gap} ZORBLATT and na\u00efve\u0301x") for i in range(3)]
    rows += [(i, f"{gap} and na\u00efve\u0301x") for i in range(3, 60)]
    rows += [(60, "Zorblatt alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    # p(e|t) is 3 in 4, which is 0.90 of -log p(e)
    assert all(out[i] == f"[term] {gap} [email] {gap} [term] and na\u00efve\u0301x" for i in range(3))
    assert all(out[i] == t for i, t in rows if i >= 3)


def test_disclosure_equals_brute_force(spark):
    words = [f"{a}{b}" for a in "bcdfgkl" for b in ("ana", "ono", "uru", "i\u0307x")]
    rows = [(i, " ".join([w for j, w in enumerate(words) if (i * 7 + j * j) % (j + 2) < 1] + [f"u{'ab'[i % 2]}{i % 9}@x.org" if i % 3 else "", "ONO"])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {i: pii.base_spans(t) for i, t in rows}
    entities = {i: pii.entities_of(t, spans[i]) for i, t in rows}
    n_entity = Counter(e for i in entities for e in entities[i])
    n_term = Counter(x for _, t in rows for x in {m.lower() for m in pii.TERM.findall(t)})
    both = Counter((e, x) for i, t in rows for e in entities[i] for x in {x for x, *_ in pii.terms_outside(t, spans[i])})
    for alpha in (0.3, 0.6):
        true = {k for k, n in both.items() if n >= 3 and math.log(n / n_term[k[1]] * len(rows) / n_entity[k[0]]) / math.log(len(rows) / n_entity[k[0]]) >= alpha}
        want = {i: [(a, b) for x, a, b in pii.terms_outside(t, spans[i]) if any((e, x) in true for e in entities[i])] for i, t in rows if spans[i]}
        got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["terms"]] for r in pii.sanitise(docs, alpha=alpha).collect()}
        assert true and got == want


def test_language_counts_are_never_cut(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)), "ab"[i % 2]) for i in range(15)]
    learned = [(t.encode(), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % langid.FOLDS != langid.HELD]
    counts = {x: np.unique(langid.strings_of([t for t, lang in learned if lang == x])[0], return_counts=True) for x in "ab"}
    assert sum(len(k) for k, _ in counts.values()) > 1 << 18
    got, want = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")), langid.Trees.grow(counts)
    assert got.langs == want.langs
    for k in range(langid.ORDER + 1):
        assert np.array_equal(got.strings[k], want.strings[k]) and np.allclose(got.bits[k], want.bits[k])
