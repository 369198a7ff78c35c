"""Quality scores from pairwise preferences: a Bradley-Terry model on features of the text.

A document labelled good is preferred to one labelled bad. The model says that a preference has log-odds w.(a - b)
for the features a and b of the two; w is learned by logistic loss on the feature differences of many such pairs.
A document's score is then its log-odds of beating a document at the threshold, the quantile of the scores at which
as many documents fail as are labelled bad.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.common import crc_bucket, labelled_sample

FOLDS, HELD = 5, 0
#: Bound of the sample of labelled documents that the model is fitted on, for each class.
PER_CLASS = 10_000
#: Winners drawn for each loser, and losers for each winner.
PAIRS = 8
CUT = 0.3
RIDGE = 1e-3

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SPACES = b" \t\n\r\x0b\x0c"
POINTS = b".,;:'\"()-?"
HIGH = bytes(range(128, 256))
ODD = bytes(sorted(set(range(256)) - set(UPPER + LOWER + DIGITS + SPACES + POINTS + HIGH)))
ALL = bytes(range(256))
NAMES = (
    "words", "mean_word", "distinct", "commonest", "next_same", "shingles_again", "lines_again", "upper", "digits",
    "points", "odd", "exclaim", "pipes", "odd_ends", "short_lines",
)



KEEP = {name: bytes(sorted(set(ALL) - set(chars))) for name, chars in (("upper", UPPER), ("digits", DIGITS), ("points", POINTS), ("odd", ODD))}


def features(text: str | None) -> list[float]:
    """What a text looks like, whole and whatever its language. Null and empty texts have no words and all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    lines = raw.split(b"\n")
    counts = Counter(words)
    size = len(raw)
    shingles = n - 2
    return [
        np.log1p(n),
        min(size / n, 40.0),
        len(counts) / n**0.8,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / shingles if shingles > 0 else 0.0,
        1 - len(set(lines)) / len(lines),
        len(raw.translate(None, KEEP["upper"])) / size,
        len(raw.translate(None, KEEP["digits"])) / size,
        len(raw.translate(None, KEEP["points"])) / size,
        len(raw.translate(None, KEEP["odd"])) / size,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        sum(w[-1] in ODD for w in words) / n,
        sum(len(x) < 20 for x in lines) / len(lines),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """The features, their square roots (small shares matter) and whether each is there at all."""
    return np.hstack([x, np.sqrt(np.abs(x)), x > 0.02])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((expand(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; CUT at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, bad_share: float, pairs: int = PAIRS) -> Model:
    """Fit to features and labels (1 good) by Newton steps; ``bad_share`` is the share of bad documents to reject."""
    wide = expand(x)
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-9
    z = (wide - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(z.shape[1])
    if not len(good) or not len(bad):
        return Model(mean, scale, weights, -np.inf if not len(bad) else np.inf)
    draw = np.random.default_rng(0)
    winners = np.concatenate([good[draw.integers(0, len(good), len(bad) * pairs)], np.repeat(good, pairs)])
    losers = np.concatenate([np.repeat(bad, pairs), bad[draw.integers(0, len(bad), len(good) * pairs)]])
    diff = z[winners] - z[losers]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ weights, -30, 30)))
        slope = diff.T @ (1 - p) / len(diff) - RIDGE * weights
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ weights
    # the quantile over all labelled documents: the sample holds each class in its own proportion
    mass = np.where(y == 1, (1 - bad_share) / len(good), bad_share / len(bad))
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(mass[order])
    at = min(np.searchsorted(below, bad_share), len(raw) - 2)
    return Model(mean, scale, weights, (raw[order[at]] + raw[order[at + 1]]) / 2)


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [features(t) for t in batch["text"]]})


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold; only features reach the driver."""
    sample, totals = labelled_sample(docs, labels, "quality", folds, held, per_class)
    rows = sample.mapInPandas(_feature_rows, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if not len(rows):
        return Model(np.zeros(3 * len(NAMES)), np.ones(3 * len(NAMES)), np.zeros(3 * len(NAMES)), -np.inf)
    n = sum(totals.values())
    return fit(np.array(rows["x"].tolist()), rows["y"].to_numpy(), totals.get(0, 0) / n)


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every text; an existing column of that name is replaced, all others stay."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(NAMES))))

    return docs.withColumn(out, score(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Empty and null texts get the score of a text without features. A null id is in no fold: never held out, never
    learned from. Without labels of both classes every document scores 1 (or 0, where all labels are bad). Repeated
    rows each come back; other columns are not read.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    held = F.coalesce(crc_bucket("doc_id", FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
