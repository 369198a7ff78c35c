"""Planted near copies of fingerprints and vectors against brute force, hubs and hot buckets included."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tallyworks.llm import simhash, vectors
from tallyworks.llm.blocks import block_pairs
from tallyworks.llm.common import connected_components, join_skewed


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def flipped(rng, x, bits):
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("whole", [False, True])
def test_balls_link_what_brute_force_links(spark, whole):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    fps = {signed(flipped(rng, s, d)) for s in seeds for d in range(5)}  # each 0 to 4 bits from a seed
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), whole).collect()
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert len(near) > 300
    assert least_reachable(fps, [(r["u"], r["v"]) for r in got]) == least_reachable(fps, near)


def test_every_two_bits_and_every_split_of_three_meet(spark):
    rng = random.Random(6)
    pairs = []
    for where in [(0, 1, 2), (20, 21, 42), (41, 42, 63), (0, 20, 41), (0, 42, 63), (21, 22, 23), (61, 62, 63), (5, 30, 55), (5,), (30, 55)]:
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in where)))
    got = simhash.links(spark.createDataFrame([(signed(f),) for p in pairs for f in p], "fp long")).collect()
    assert {frozenset((r["u"], r["v"])) for r in got} == {frozenset(map(signed, p)) for p in pairs}


def test_hot_bucket_of_fingerprints(spark):
    """More fingerprints within one bit of a centre's blocks than fit a block of a bucket."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {signed(centre ^ 1 << a ^ 1 << b) for a, b in itertools.combinations(range(64), 2)} | {signed(centre)}
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    found = [(r["u"], r["v"]) for r in simhash.links(rows.select("fp")).collect()]
    assert len(set(least_reachable(fps, found).values())) == 1


def test_block_pairs_bring_all_pairs_together(spark):
    rows = spark.createDataFrame([(0, i) for i in range(900)] + [(1, 5), (1, 6), (2, 7)], "b int, node long")
    got = block_pairs(rows, ["b"], "node", 64).collect()
    groups: dict = {}
    for r in got:
        groups.setdefault((r["b"], r["left"], r["right"]), []).append((r["node"], r["side"]))
    met = set()
    for (b, _, _), g in groups.items():
        for (x, s), (y, t) in itertools.combinations(g, 2):
            if s == 0 or s != t:
                assert (b, min(x, y), max(x, y)) not in met
                met.add((b, min(x, y), max(x, y)))
    assert met == {(0, x, y) for x, y in itertools.combinations(range(900), 2)} | {(1, 5, 6)}
    assert max(map(len, groups.values())) < 300


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_skewed_equals_join(spark, how):
    rows = spark.createDataFrame([(0, i) for i in range(500)] + [(k, k) for k in range(1, 40)] + [(None, 1)], "k long, x long")
    per_key = rows.where("k is not null and k % 3 = 0").groupBy("k").count()
    a = join_skewed(rows, per_key, ["k"], "count", 540, how).select("k", "x", "count").collect()
    b = rows.join(per_key, "k", how).select("k", "x", "count").collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_components_of_hubs_chains_and_cycles(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 3000), (5, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    links = [(u, v) for u, v in edges if v is not None]
    assert got == least_reachable({x for e in edges for x in e if x is not None}, links)


def planted(rng, n, dim, groups, chance):
    """Random vectors, half of them with near copies whose cosine is spread from 0.97 to 1 and at the threshold."""
    x = rng.standard_normal((n, dim))
    out, label = [*x], [*rng.choice(groups, n, p=chance)]
    for i in range(n // 2):
        for cos in (0.98001, rng.uniform(0.97, 0.9799), rng.uniform(0.98, 1)):
            z = rng.standard_normal(dim)
            z -= z @ x[i] / (x[i] @ x[i]) * x[i]
            z *= np.linalg.norm(x[i]) / np.linalg.norm(z)
            out.append((cos * x[i] + np.sqrt(1 - cos * cos) * z) * rng.uniform(0.1, 10))
            label.append(label[i] if rng.random() < 0.9 else rng.choice(groups))
    return np.array(out), np.array(label)


def test_planted_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x, label = planted(rng, 1600, 64, [0, 1, 2, 9], [0.5, 0.3, 0.19, 0.01])
    tight = rng.standard_normal(64) + 0.05 * rng.standard_normal((700, 64))  # a group of near copies beyond a block
    copies = np.repeat(rng.standard_normal((3, 64)), 200, axis=0)
    x, label = np.concatenate([x, tight, copies]), np.concatenate([label, np.full(700, 1), np.repeat([0, 1, 1], 200)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    n = linked.sum(axis=1)
    least = least_reachable(range(len(x)), zip(*np.nonzero(np.triu(linked)), strict=True))
    frame = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(frame.repartition(8)).collect()}
    assert len(got) == len(x)
    assert all(got[i]["n_links"] <= n[i] for i in got)
    planted_n, planted_got = n[:4000].sum(), sum(got[i]["n_links"] for i in range(4000))
    assert planted_n > 1000
    print(f"recall: {planted_got / planted_n:.4f} of {planted_n} planted, {sum(r['n_links'] for r in got.values()) / n.sum():.4f} of {n.sum()} in all")
    assert planted_got >= 0.95 * planted_n and sum(r["n_links"] for r in got.values()) >= 0.95 * n.sum()
    assert sum(got[i]["component_id"] == least[i] for i in got) >= 0.97 * len(got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_few_vectors_and_clashing_names(spark):
    rows = [(1, [1.0, 0.01], 1, 0), (2, [1.0, 0.0], 1, 0), (3, [0.0, 1.0], 1, 0), (4, [1.0], 1, 0), (5, [2.0], 1, 0), (6, [-1.0], 1, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node long")
    frame = frame.withColumns({c: frame["node"] for c in ("dim", "near", "p", "h1", "part", "copies", "side", "n")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
