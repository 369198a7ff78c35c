"""Toxicity by weak supervision.

Many voters look at a text: lexicons (each a group of word parts that turn up together, in so many different words at
least), a general lexicon of insults, and patterns. Given labels only choose which lexicons may vote. A generative
model learns from the votes alone, by EM, how many texts are toxic, how often each voter votes on toxic and on clean
ones, and how each two voters correlate within a class: toxic texts come in kinds (languages, say) that make voters
vote together or never, and voters who repeat each other beyond that count as fewer. A linear classifier is trained
on the posterior labels of that model, never on the given ones, and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import crc_bucket, labelled_sample

FOLDS, HELD = 3, 1
#: Bound of the sample of labelled documents that lexicons, voters and classifier are fitted on, for each class.
PER_CLASS = 10_000
CUT = 0.7
#: The units of lexicons: parts of words, beginnings of words, and whole words of up to WHOLE characters, each at
#: LEVELS of how many different words of the text have it.
PART, HEADS, WHOLE = 5, (4, 5, 6), 16
LEVELS = (1, 2, 3, 5)
#: Size of the model: the strongest units that it knows.
GRAMS = 768
#: Belief in a text being toxic before anything is known of its voters, by how many of them vote.
FIRST_BELIEF = (0.02, 0.5, 0.95)
#: Correlation over all texts from which two voters vote for the same kind of toxic texts.
TOGETHER = 0.15
#: A gram's surprise that is a vote of its own.
ODD = 8.0
#: A unit is known if in so many toxic texts of the sample, in so many times the clean texts' share; it votes from TRUSTED.
LEAST, KNOWN, TRUSTED = 4, 20, 100
RIDGE = 10.0

#: General insults, whole words.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "fool", "jerk")
PATTERNS = (
    re.compile(r"(?i)\b(?:shut\s+up|get\s+lost|go\s+to\s+hell|i\s+hate\s+you)\b"),
    re.compile(r"(?i)\byou(?:'re|\s+are)?\s+(?:a|an|such\s+an?)\s+\w+!"),
    re.compile(r"(?:[*#@$%&]{2,}\w|\w[*#@$%&]{2,}\w)"),
    re.compile(r"(?:\b[A-Z]{4,}\b\W+){4,}"),
)
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The text's different lower-cased words, with spaces around each."""
    return f" {' '.join(set(NOT_LETTERS.sub(' ', (text or '').lower()).split()))} "


def level_of(n: int) -> list[int]:
    return [x for x in LEVELS if x <= n]


def grams(text: str | None) -> dict[str, int]:
    """Word parts, beginnings and short whole words of a text, with how many different words have each.

    Spaces mark the ends of words.
    """
    out: dict[str, int] = {}
    for word in letters(text).split():
        w = f" {word} "
        parts = {w[i : i + PART] for i in range(1, len(w) - PART)}
        parts.update(w[:n] for n in HEADS if n < len(w))
        if len(w) <= WHOLE:
            parts.add(w)
        for g in parts:
            out[g] = out.get(g, 0) + 1
    return out


@dataclass(frozen=True)
class Model:
    """Mined (gram, level) units, the voter each belongs to, and the linear classifier on voters and units."""

    grams: tuple[tuple[str, int], ...]
    voter: tuple[int, ...]
    rates: dict[str, float]  # how many of a clean text's different words have a gram
    weights: np.ndarray
    bias: float

    def automaton(self) -> ahocorasick.Automaton:
        units: dict[str, list[tuple[int, int]]] = {}
        for k, (gram, level) in enumerate(self.grams):
            units.setdefault(gram, []).append((level, k))
        found = ahocorasick.Automaton()
        for gram, levels in units.items():
            found.add_word(gram, (gram, levels))
        if units:
            found.make_automaton()
        return found


def hits(text: str | None, automaton: ahocorasick.Automaton) -> tuple[list[int], dict[str, int], int]:
    """The units that a text has, how many different words have each mined gram, and how many there are."""
    words = letters(text)
    count: dict[str, int] = {}
    levels = {}
    if len(automaton):
        for _, (gram, units) in automaton.iter(words):
            count[gram] = count.get(gram, 0) + 1
            levels[gram] = units
    return sorted(k for gram, n in count.items() for level, k in levels[gram] if n >= level), count, words.count(" ") - 1


def surprise(count: dict[str, int], words: int, rates: dict[str, float]) -> float:
    """The largest log-likelihood ratio of a gram's count over the count that a clean text of this length has."""
    best = 0.0
    for gram, n in count.items():
        due = rates[gram] * words
        if n > due:
            best = max(best, n * math.log(n / due) - n + due)
    return best


def patterns(text: str | None) -> list[int]:
    """Which fixed voters vote: the general lexicon, then each pattern."""
    words = letters(text)
    return [int(any(f" {w} " in words for w in INSULTS)), *[int(p.search(text or "") is not None) for p in PATTERNS]]


@dataclass(frozen=True)
class LabelModel:
    """What the votes say: belief in each text, rates of votes on toxic and clean texts, correlations of voters."""

    posterior: np.ndarray
    prior: float
    on: np.ndarray
    off: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray


def correlations(rest: np.ndarray) -> np.ndarray:
    cov = rest.T @ rest / max(1, len(rest))
    sd = np.sqrt(np.diag(cov)) + 1e-9
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    return corr


def kinds_of(votes: np.ndarray, together: float = TOGETHER) -> np.ndarray:
    """Groups of voters that vote on the same texts, by average linkage of their correlations over all texts.

    Voters that stay alone tell no kind and have -1, unless all do, who are then one group.
    """
    m = votes.shape[1]
    like = correlations(votes - votes.mean(axis=0))
    np.fill_diagonal(like, -np.inf)
    label, size = np.arange(m), np.ones(m)
    while m > 1:
        a, b = divmod(int(like.argmax()), m)
        if like[a, b] < together:
            break
        like[a] = like[:, a] = (size[a] * like[a] + size[b] * like[b]) / (size[a] + size[b])
        like[a, a] = -np.inf
        like[b] = like[:, b] = -np.inf
        size[a] += size[b]
        label[label == b] = a
    alone = np.bincount(label, minlength=m)[label] == 1
    if alone.all():
        return np.zeros(m, int)
    out = np.full(m, -1)
    out[~alone] = np.unique(label[~alone], return_inverse=True)[1]
    return out


def label_model(votes: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM over binary votes (texts in rows, voters in columns), without any label.

    A text is clean or toxic of one of ``kinds_of`` kinds. The start tells them apart: a text is believed to be of the
    kind whose voters vote on it, the more the surer. ``correlation`` is what clean and toxic leave unexplained of
    each two voters. What the kinds leave unexplained, too, are repeats: a voter's weight is 1 over 1 plus that.
    """
    n, m = votes.shape
    kind = kinds_of(votes)
    by_kind = votes @ (kind[:, None] == np.arange(kind.max() + 1))
    belief = np.array(FIRST_BELIEF)[np.minimum(by_kind.max(axis=1).astype(int), len(FIRST_BELIEF) - 1)]
    member = np.zeros((n, by_kind.shape[1] + 1))  # clean, then each kind
    member[:, 0] = 1 - belief
    member[np.arange(n), by_kind.argmax(axis=1) + 1] = belief
    for _ in range(rounds):
        size = member.sum(axis=0)
        rate = (member.T @ votes + np.where(np.arange(len(size)) == 0, 0.05, 0.5)[:, None] * votes.mean(axis=0)) / (size + 1)[:, None]
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        weight = 1 / (1 + np.maximum(correlations(votes - member @ rate), 0).sum(axis=1))
        odds = np.log(size / n + 1e-9) + (votes * weight) @ np.log(rate).T + ((1 - votes) * weight) @ np.log(1 - rate).T
        new = np.exp(odds - odds.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - member).max() < 1e-6
        member = new
        if done:
            break
    post = 1 - member[:, 0]
    on, off = post @ votes / max(post.sum(), 1e-9), (1 - post) @ votes / max((1 - post).sum(), 1e-9)
    corr = correlations(votes - post[:, None] * on - (1 - post)[:, None] * off)
    return LabelModel(post, float(post.mean()), on, off, corr, weight)


def linear(x: np.ndarray, target: np.ndarray, mass: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with row masses, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    mass = mass / mass.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (mass * (target - p)) - keep * w / len(x)
        curve = (z * (mass * p * (1 - p))[:, None]).T @ z + np.diag(keep / len(x) + 1e-9)
        step = np.clip(np.linalg.solve(curve, slope), -4, 4)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def group_voters(on_doc: np.ndarray, may_vote: np.ndarray) -> np.ndarray:
    """The voter of each unit, best first: that of the earlier unit it turns up with at least half the time, else a new one.

    Units that may not vote have -1; they are inputs of the classifier only.
    """
    of = np.full(on_doc.shape[1], -1)
    heads = np.zeros((len(on_doc), 0), np.float32)
    for k in np.flatnonzero(may_vote):
        col = on_doc[:, k].astype(np.float32)
        both = col @ heads
        same = both / np.maximum(1, col.sum() + heads.sum(axis=0) - both)
        if len(same) and same.max() >= 0.5:
            of[k] = int(np.argmax(same))
        else:
            of[k] = heads.shape[1]
            heads = np.column_stack([heads, col])
    return of


def inputs(on_doc: np.ndarray, fixed: np.ndarray, voter: np.ndarray, odd: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, classifier inputs): mined voters vote where any of their units turns up, the fixed ones follow."""
    n = voter.max() + 1 if len(voter) else 0
    mined = np.zeros((len(on_doc), n))
    for v in range(n):
        mined[:, v] = on_doc[:, voter == v].any(axis=1)
    odd = odd[:, None]
    votes = np.hstack([mined, fixed, odd > ODD]).astype(float)
    style = [np.log1p(on_doc.sum(axis=1, keepdims=True)), np.sqrt(odd), odd > ODD / 2, np.log1p(words[:, None])]
    return votes, np.hstack([votes, *style, on_doc.astype(float)])


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for y, texts in batch.groupby("y")["text"]:
            count: dict[tuple[str, int], int] = {}
            for t in texts:
                for g, n in grams(t).items():
                    for level in level_of(n):
                        count[g, level] = count.get((g, level), 0) + 1
            if not count:
                continue
            units, n = list(count), np.array(list(count.values()))
            yield pd.DataFrame({"gram": pd.Series([g for g, _ in units], dtype=object), "level": [x for _, x in units], "toxic": n * int(y), "clean": n * (1 - int(y))})


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, per_class: int = PER_CLASS) -> Model:
    """Mine lexicons, fit the label model and train the classifier on a bounded sample outside the held-out fold.

    At most GRAMS units and, for each sampled document, the units and patterns it has reach the driver.
    """
    sample, totals = labelled_sample(docs, labels, "toxic", folds, held, per_class)
    n_of = {y: min(per_class, totals.get(y, 0)) for y in (0, 1)}
    if not n_of[0] or not n_of[1]:
        return Model((), (), {}, np.zeros(len(PATTERNS) + 6), np.inf if n_of[1] else -np.inf)
    counts = sample.mapInPandas(_gram_counts, "gram string, level int, toxic long, clean long")
    counts = counts.groupBy("gram", "level").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = lambda c, k: (F.col(c) + 0.1) / (n_of[k] + 0.2)
    strength = F.col("toxic") / n_of[1] * F.log(share("toxic", 1) / share("clean", 0))
    ratio = share("toxic", 1) / share("clean", 0)
    telling = counts.where((F.col("toxic") >= LEAST) & (ratio > KNOWN)).withColumn("votes", ratio > TRUSTED)
    best = telling.orderBy(strength.desc(), "gram", "level").limit(GRAMS).collect()
    found = tuple((r["gram"], r["level"]) for r in best)
    machine = Model(found, (), {}, np.zeros(0), 0.0)
    names = sorted({g for g, _ in found})
    place = {g: k for k, g in enumerate(names)}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = machine.automaton()
        for b in batches:
            seen = [hits(t, automaton) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "y": b["y"], "hits": [h for h, _, _ in seen], "fixed": [patterns(t) for t in b["text"]],
                "gram": [[place[g] for g in c] for _, c, _ in seen], "count": [list(c.values()) for _, c, _ in seen],
                "words": [w for _, _, w in seen],
            })

    shape = "doc_id long, y int, hits array<int>, fixed array<int>, gram array<int>, count array<int>, words long"
    rows = sample.mapInPandas(look, shape).toPandas().sort_values("doc_id", kind="stable")
    if not len(rows):  # labels, but none of the documents
        return Model((), (), {}, np.zeros(len(PATTERNS) + 6), -np.inf)
    clean = rows[rows["y"] == 0]
    have = np.bincount(np.concatenate([*clean["gram"], []]).astype(int), weights=np.concatenate([*clean["count"], []]), minlength=len(names))
    rates = dict(zip(names, ((have + 0.5) / (clean["words"].sum() + 1)).tolist(), strict=True))
    on_doc = np.zeros((len(rows), len(found)), bool)
    odd = np.zeros(len(rows))
    for i, (h, g, n, w) in enumerate(zip(rows["hits"], rows["gram"], rows["count"], rows["words"], strict=True)):
        on_doc[i, np.asarray(h, int)] = True
        odd[i] = surprise({names[k]: c for k, c in zip(g, n, strict=True)}, w, rates)
    voter = group_voters(on_doc, np.array([r["votes"] for r in best], bool))
    votes, x = inputs(on_doc, np.array(rows["fixed"].tolist()), voter, odd, rows["words"].to_numpy(float))
    posterior = label_model(votes).posterior
    # the sample holds at most so many rows of a class: each back to its share among all labelled documents
    every = sum(totals.values())
    mass = np.where(rows["y"] == 1, totals[1] / every / n_of[1], totals[0] / every / n_of[0])
    weights, bias = linear(x, posterior, mass)
    return Model(found, tuple(voter.tolist()), rates, weights, bias)


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add the probability that a text is toxic; an existing column of that name is replaced, all others stay."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        automaton = model.automaton()
        out = np.empty(len(texts))
        voter = np.array(model.voter, int)
        for at in range(0, len(texts), 1000):
            part = texts.iloc[at : at + 1000]
            on_doc, odd, words = np.zeros((len(part), len(model.grams)), bool), np.zeros(len(part)), np.zeros(len(part))
            for i, t in enumerate(part):
                units, count, words[i] = hits(t, automaton)
                on_doc[i, units] = True
                odd[i] = surprise(count, words[i], model.rates)
            _, x = inputs(on_doc, np.array([patterns(t) for t in part]), voter, odd, words)
            out[at : at + 1000] = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -500, 500)))
        return pd.Series(out)

    return docs.withColumn(out, score(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Empty and null texts have no votes and score as such texts do. A null id is in no fold: never held out, never
    learned from. Without labels of both classes every document scores 0 (or 1, where all labels are toxic).
    Repeated rows each come back; other columns are not read.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels), out="score")
    held = F.coalesce(crc_bucket("doc_id", FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
