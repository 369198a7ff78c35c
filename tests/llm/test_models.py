"""The learned models against slow versions: label model, ranking, language trees, segmentation search, spectra."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np

from tallyworks.llm import langid, media, pieces, quality, toxicity
from tallyworks.llm.common import may_have


def simulated_votes(rng, n=20_000):
    """Toxic texts of two kinds, eight voters for each, one of them repeated, and two voters of chance."""
    kind = rng.choice(3, n, p=[0.85, 0.1, 0.05])
    rate = np.zeros((3, 19))
    rate[1, :8], rate[2, 8:16] = rng.uniform(0.3, 0.7, 8), rng.uniform(0.3, 0.7, 8)
    rate[0, :16] = rng.uniform(0.0, 0.02, 16)
    rate[:, 17:] = 0.05
    votes = (rng.random((n, 19)) < rate[kind]).astype(float)
    votes[:, 16] = np.where(rng.random(n) < 0.95, votes[:, 0], votes[:, 16])
    return votes, kind > 0


def test_label_model_recovers_accuracies_and_correlations():
    rng = np.random.default_rng(3)
    votes, toxic = simulated_votes(rng)
    found = toxicity.label_model(votes)
    assert abs(found.prior - toxic.mean()) < 0.02
    assert ((found.posterior > 0.5) == toxic).mean() > 0.98
    assert np.abs(found.on - votes[toxic].mean(axis=0)).max() < 0.05
    assert np.abs(found.off - votes[~toxic].mean(axis=0)).max() < 0.02
    rest = votes - np.where(toxic[:, None], votes[toxic].mean(axis=0), votes[~toxic].mean(axis=0))
    true = np.corrcoef(rest.T) - np.eye(19)
    assert np.abs(found.correlation - true).max() < 0.12
    assert found.correlation[0, 16] > 0.9 and found.correlation[1, 9] < 0 and abs(found.correlation[17, 18]) < 0.05
    assert found.weight[0] < 0.6 and found.weight[16] < 0.6 and found.weight[1:16].min() > 0.7  # the repeat counts half


def test_label_model_without_votes():
    found = toxicity.label_model(np.zeros((10, 4)))
    assert (found.posterior < 0.5).all() and np.isfinite(found.correlation).all()


def test_soft_logistic_regression_is_a_stationary_point():
    rng = np.random.default_rng(4)
    x, target, mass = rng.standard_normal((400, 5)), rng.random(400), rng.random(400) + 0.1
    w, b = toxicity.linear(x, target, mass)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (mass / mass.sum()) @ (np.logaddexp(0, z) - target * z) + (toxicity.RIDGE * v[:-1] @ v[:-1] + 1e-6 * v[-1] ** 2) / 2 / len(x)

    at = np.append(w, b)
    slope = [(loss(at + 1e-5 * e) - loss(at - 1e-5 * e)) / 2e-5 for e in np.eye(6)]
    assert np.abs(slope).max() < 1e-5


def test_preferences_are_fitted_by_logistic_loss():
    """The weights are a minimum of the loss over the same pairs of features, and the quantile rejects as many as are bad."""
    rng = np.random.default_rng(5)
    x = np.abs(rng.standard_normal((300, len(quality.NAMES))))
    y = (x[:, 0] + 0.3 * rng.standard_normal(300) > 0.4).astype(int)
    model = quality.fit(x, y, (y == 0).mean())
    z = (quality.expand(x) - model.mean) / model.scale
    draw = np.random.default_rng(0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    won = np.concatenate([good[draw.integers(0, len(good), len(bad) * quality.PAIRS)], np.repeat(good, quality.PAIRS)])
    lost = np.concatenate([np.repeat(bad, quality.PAIRS), bad[draw.integers(0, len(bad), len(good) * quality.PAIRS)]])
    assert (y[won] == 1).all() and (y[lost] == 0).all()

    def loss(w):
        return np.logaddexp(0, -(z[won] - z[lost]) @ w).mean() + quality.RIDGE * w @ w / 2

    best = loss(model.weights)
    slope = [(loss(model.weights + 1e-5 * e) - loss(model.weights - 1e-5 * e)) / 2e-5 for e in np.eye(z.shape[1])]
    assert np.abs(slope).max() < 1e-4
    assert all(loss(model.weights + 0.05 * rng.standard_normal(z.shape[1])) > best for _ in range(50))
    assert abs((model.score(x) < quality.CUT).sum() - (y == 0).sum()) <= 2


def slow_bits(counts, text):
    """Bits of a text by escape method C, from the counts of (context, next byte) of every order."""
    total = 0.0
    padded = b"\0" * langid.ORDER + text
    for i in range(langid.ORDER, len(padded)):
        nxt, bits = padded[i], None
        escapes = 0.0
        for order in range(langid.ORDER, -1, -1):
            seen = counts.get(padded[i - order : i])
            if seen is None:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if nxt in seen:
                bits = math.log2((n + kinds) / seen[nxt])
                break
            escapes += math.log2((n + kinds) / kinds)
        total += escapes + (8.0 if bits is None else bits)
    return total


def test_code_lengths_equal_slow_trees(spark):
    texts = {"a": ["the cat sat on the mat", "the rat", "éa", "x" * 40], "b": ["der hund und die katze", "das", "ëb bb"]}
    docs = spark.createDataFrame([(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, text string, lang string")
    trees = langid.train(docs, folds=1, held=1)
    asked = [b"the hund sat", b"", "été".encode(), b"zzz", b"the cat sat on the mat", bytes(range(1, 128))]
    got = trees.totals(asked)
    for c, lang in enumerate(trees.langs):
        counts: dict = {}
        for t in texts[lang]:
            raw = b"\0" * langid.ORDER + t.encode()
            for i in range(langid.ORDER, len(raw)):
                for order in range(langid.ORDER + 1):
                    counts.setdefault(raw[i - order : i], {}).setdefault(raw[i], 0)
                    counts[raw[i - order : i]][raw[i]] += 1
        assert np.allclose(got[:, c], [slow_bits(counts, t) for t in asked])


def test_equal_code_lengths_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(0, "abc", "b"), (0, "abc", "a"), (2, "abcx", None)], "doc_id long, text string, lang string")
    found = langid.with_language(docs, langid.train(docs, folds=1, held=1)).collect()
    assert all(r["language"]["lang"] == "a" and abs(r["language"]["score"] - 0.5) < 1e-12 for r in found)


def test_search_equals_all_segmentations_of_random_texts():
    vocabulary = pieces.Vocabulary.load()
    rng = random.Random(9)
    words = [p for p in vocabulary.ids if 2 <= len(p) <= 6 and pieces.SPACE not in p]

    def every(key):
        if not key:
            return [(0.0, ())]
        return [(vocabulary.scores[key[:n]] + s, (vocabulary.ids[key[:n]], *p)) for n in range(1, len(key) + 1) if key[:n] in vocabulary.ids for s, p in every(key[n:])]

    encoder = pieces.Encoder(vocabulary, 4)
    for _ in range(150):
        unit = " " * rng.randint(0, 2) + "".join(rng.choices(words, k=rng.randint(1, 2)))[:9]
        key = unit.replace(" ", pieces.SPACE)
        if any(ch not in vocabulary.ids for ch in key):
            continue
        all_of = sorted(every(key), reverse=True)[:4]
        found = vocabulary.n_best(unit, 4)
        assert [s for s, _ in found] == [s for s, _ in all_of]
        assert len({ids for _, ids in found}) == len(found)
        # the forward pass that texts are encoded by ends where the search's first path does
        score, cost, _, ids = encoder.viterbi([unit])
        assert score[0] == found[0][0] and sum(vocabulary.scores[p] for i in ids for p in [next(k for k, v in vocabulary.ids.items() if v == i)]) == score[0]
        assert cost[0] == (found[0][0] - found[1][0] if len(found) > 1 else np.inf)


def test_texts_of_several_words_against_search_of_the_whole():
    """Combining the words' own choices gives what a search over the whole text's lattice gives."""
    vocabulary = pieces.Vocabulary.load()
    rng = random.Random(10)
    words = [p.replace(pieces.SPACE, "") for p in vocabulary.ids if 2 <= len(p) <= 7]
    encoder = pieces.Encoder(vocabulary, 3)
    for _ in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(1, 6)))
        whole = vocabulary.n_best(" " + text, 3)
        found = encoder.encode(text)
        assert [s for s, _ in found] == [s for s, _ in whole]
        assert all(encoder.decode(ids) == text for _, ids in found)


def test_spectral_peaks_equal_a_slow_transform():
    rng = np.random.default_rng(11)
    samples = rng.integers(0, 256, 192 * 3).astype(np.uint8)
    samples[192:384] = 128  # a silent frame
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 191) for i in range(192)]
    want = []
    for t, at in enumerate(range(0, len(samples) - 191, 96)):
        frame = [(float(s) - 128) * w for s, w in zip(samples[at : at + 192], window, strict=True)]
        level = []
        for k in range(97):
            re = sum(x * math.cos(2 * math.pi * k * i / 192) for i, x in enumerate(frame))
            im = sum(x * math.sin(2 * math.pi * k * i / 192) for i, x in enumerate(frame))
            level.append(round(20 * math.log10(1 + math.hypot(re, im))))
        peaks = sorted((-level[k], k) for k in range(1, 96) if level[k] > level[k - 1] and level[k] >= level[k + 1] and level[k] > 0)
        want += [(t, k) for _, k in peaks[:3]]
    times, bins = media.spectral_peaks(samples)
    assert list(zip(times.tolist(), bins.tolist(), strict=True)) == want
    at, code = media.peak_pairs(times, bins)
    pairs = sorted((a, i << 16 | j << 8 | b - a) for (a, i), (b, j) in itertools.combinations(want, 2) if 1 <= b - a <= 3)
    assert list(zip(at.tolist(), code.tolist(), strict=True)) == pairs


def test_file_comes_back_from_its_column(spark):
    docs = spark.createDataFrame([(1, "é" * 500), (2, None), (3, ""), (4, "é" * 500)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in media.with_fingerprint(media.with_media(docs)).collect()}
    for i, text in ((1, "é" * 500), (2, ""), (3, "")):
        assert media.from_wav(bytes(rows[i]["media"])) == media.padded(text)
        assert rows[i]["fingerprint"]["payload_bytes"] == len(media.padded(text))
    assert rows[1]["fingerprint"] == rows[4]["fingerprint"] and rows[2]["fingerprint"] == rows[3]["fingerprint"]


def test_languages_by_parts_are_those_of_all_trees(spark):
    rng = random.Random(21)
    rows = [(i, "".join(rng.choices("aeiou nrst" if i % 2 else "xyzwaeé\n ", k=rng.randint(0, 400))), "ab"[i % 2]) for i in range(90)]
    rows += [(100, None, "a"), (101, "123", "b"), (102, "only known here: qqq", "c"), (5, rows[5][1], "b"), (None, "aeiou", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = langid.counted(docs).cache()
    assert len(langid.parts_of(counts, 60)) > 5 and len(langid.parts_of(counts)) == 1
    # every byte is in one part, however few its counts
    assert sorted(b for part in langid.parts_of(counts, 1) for b in part) == sorted({r["string"] >> 8 & 255 for r in counts.collect()})
    want = {(r["doc_id"], r["text"]): r["language"] for r in langid.with_language(docs, langid.train(docs)).collect()}
    for part in (60, langid.PART):
        got = langid.with_learned_language(docs, counts, part=part).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["language"]["lang"] == want[r["doc_id"], r["text"]]["lang"] and abs(r["language"]["score"] - want[r["doc_id"], r["text"]]["score"]) < 1e-9


def test_rows_that_may_have_a_key(spark):
    rows = spark.range(20_000).selectExpr("unhex(md5(cast(id as string))) as k", "id")
    keys = rows.where("id % 500 = 0").select("k")
    kept = {r["id"] for r in may_have(rows, keys, "k").collect()}
    assert set(range(0, 20_000, 500)) <= kept and len(kept) < 60
    assert may_have(rows, keys.limit(0), "k").collect() == [] and may_have(rows.limit(0), keys, "k").collect() == []
