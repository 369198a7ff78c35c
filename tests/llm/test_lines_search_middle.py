"""Line deduplication, ranked search and fill-in-the-middle against slow versions, and their odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyworks.llm import lexical, lines, middle

ODD = [
    (None, "a line of nobody\nand more of it", "x"), (1, None, "x"), (2, "", None), (3, "\n\n", "x"), (4, "  A Line of SOMEBODY \t\nshort\nÉcole de la VILLE\r", "x"),
    (4, "  A Line of SOMEBODY \t\nshort\nÉcole de la VILLE\r", "x"), (5, "a line of somebody\nshort\nécole de la ville\na line of somebody", "x"),
    (6, "a line of nobody\nÉcole de la ville\nshort", "x"), (7, "word another <P> 日本語😀 " * 3000, "x"), (8, "x" * 300_000, "x"), (9, "a line of nobody\n" * 4000, "x"),
    (None, "and more of it \n😀😀😀😀😀😀😀😀😀😀", "x"), (10, "😀😀😀😀😀😀😀😀😀😀\n😀😀😀😀😀😀😀😀😀", "x"),
]
EXTRA = ("n", "key", "pos", "first", "n_lines", "n_dropped", "form", "shard", "term", "ids", "rank", "item", "line", "output")


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.withColumns({c: docs["doc_id"].cast("string") for c in EXTRA})


def random_rows(seed, n):
    rng = random.Random(seed)
    parts = ["alpha beta gamma", "ALPHA BETA gamma", " alpha beta gamma", "tiny", "", "Ünïcode line über", "ünïcode line über", "12345 67890", "1234567890\v"]
    return [(i, "\n".join(rng.choice(parts) + rng.choice(["", "", " ", f" {rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 12))), "s") for i in range(n)]


def slow_lines(rows, shortest=10, documents=2):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    key = lambda line: low(line.strip(" \t\n\v\f\r"))
    at = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            at[key(line)].add((i is None, i or 0))
    out = []
    for i, text, *_ in rows:
        all_lines = (text or "").split("\n")
        gone = lambda x: len(key(x)) >= shortest and len(at[key(x)]) >= documents and min(at[key(x)]) != (i is None, i or 0)  # noqa: B023, E731
        kept = [x for x in all_lines if not gone(x)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rows", "documents"), [(ODD, 2), (random_rows(1, 60), 2), (random_rows(2, 60), 3), ([], 2)])
def test_lines_equal_a_slow_version(spark, rows, documents):
    docs = frame(spark, rows)
    got = lines.without_repeats(docs, documents=documents)
    assert sorted(got.columns) == sorted(docs.columns)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == slow_lines(rows, documents=documents)


def test_a_line_of_every_document_is_spread(spark):
    rows = [(i, f"the line that all documents have\nown line number {i} of this one", "s") for i in range(3000)]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own line number {i} of this one" for i in range(1, 3000))


def slow_middle(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, x = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 2, 7, middle.CHUNK])
def test_middle_equals_a_slow_version(spark, chunk):
    rng = random.Random(chunk)
    alphabet = ["a", "b", "Z", "é", "😀", " ", "\n", "<", "S", ">", "1", "\x00"]
    rows = [r for r in ODD if chunk > 100 or len(r[1] or "") < 200] + [(100 + i, "".join(rng.choices(alphabet, k=rng.randint(1, 40))), "s") for i in range(300)]
    docs = frame(spark, rows)
    out = middle.with_middle(docs, chunk=chunk)
    assert sorted(out.columns) == sorted({*docs.columns, "prefix_chars", "middle_chars"})
    got = out.withColumn("again", middle.restored("output", "form")).collect()
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(((i, *slow_middle(i, t)) for i, t, _ in rows), key=key)
    assert all(r["again"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert middle.with_middle(docs.limit(0), chunk=chunk).collect() == []


def slow_search(rows, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(terms(t))) for i, t, *_ in rows]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, c in asked.items():
        scored = []
        for i, d in docs:
            m = 75 + 25 * d.total() * n_docs // n_terms if n_terms else 75
            score = sum(q * w[t] * (1_000_000_000 * d[t] // (1000 * d[t] + 12 * m)) for t, q in c.items() if t in d)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(0, "A line of nobody"), (1, None), (2, ""), (3, "école VILLE école"), (4, "日本語😀 another"), (4, "word"), (None, "short line"), (6, "nothing of this kind 0123")]


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 60))), "s") for i in range(n)]
    return rows + [(n + i, rows[i % 3][1], "s") for i in range(n // 3)], [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(25)]


@pytest.mark.parametrize("shard", [5, 64, lexical.DOCS])
def test_search_equals_a_slow_version(spark, shard):
    for rows, items in (prose(shard, 400), (ODD, ITEMS)):
        found = lexical.search(frame(spark, rows).repartition(2), spark.createDataFrame(items, "item_id long, text string"), docs_a_shard=shard)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == slow_search(rows, items)


def test_search_with_blocks_of_items_and_few_terms_known(spark, monkeypatch):
    rows, items = prose(9, 200)
    monkeypatch.setattr(lexical, "ITEM_TERMS", 40)  # several blocks, and an index of every term
    found = lexical.search(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == slow_search(rows, items)


def test_search_of_nothing(spark):
    docs, items = frame(spark, ODD), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("coalesce(text, '') = ''"), items).collect() == []


def test_blocks_cost_least(spark):
    rng = random.Random(4)
    lists = [[rng.choice([10, 20, 500, 900]) + rng.randint(0, 9) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    ends = lexical.cut_lists(np.array([v for x in lists for v in x], np.int64), starts, per_block=300, longest=4)

    def cost(values, cuts):
        edges = [0, *cuts]
        return sum(300 + sum(max(values[a:b]) - v for v in values[a:b]) for a, b in zip(edges, edges[1:], strict=False))

    def least(values):
        best = [0] + [math.inf] * len(values)
        for j in range(1, len(values) + 1):
            best[j] = min(best[i] + 300 + sum(max(values[i:j]) - v for v in values[i:j]) for i in range(max(0, j - 4), j))
        return best[-1]

    for at, values in zip(starts, lists, strict=False):
        mine = [int(e - at) for e in ends if at < e <= at + len(values)]
        assert (mine[-1] if mine else 0) == len(values) and cost(values, mine) == least(values)


def test_a_search_reads_few_blocks_and_loses_nothing():
    rng = np.random.default_rng(3)
    size, lists = 4000, []
    for share in (0.02, 0.1, 0.5):
        at = np.flatnonzero(rng.random(size) < share)
        lists.append((at, (rng.pareto(1.5, len(at)) * 1000).astype(np.int64) + 1))
    list_ends = np.cumsum([len(a) for a, _ in lists])
    places, impacts = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
    ends = lexical.cut_lists(impacts, np.concatenate([[0], list_ends]), per_block=2000)
    highest = np.maximum.reduceat(impacts, np.concatenate([[0], ends[:-1]]))
    weights = np.array([900, 300, 20])
    total = np.zeros(size, np.int64)
    for w, (a, x) in zip(weights, lists, strict=True):
        total[a] += w * x
    want = sorted(((-int(s), p) for p, s in enumerate(total) if s))[:20]
    assert lexical.best_of((list_ends, ends, highest, places, impacts), weights, size) == [(p, -s) for s, p in want]
