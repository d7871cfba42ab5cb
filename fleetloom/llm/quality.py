"""Quality classifier learned from trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import bounded_sample

# Classes of bytes: space, line ends and other control, small, capital, digit, punctuation, symbol, not ASCII.
CLASSES = 8
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[:32] = 1
_CLASS[32] = 0
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 5
_CLASS[128:] = 7
FEATURES = CLASSES**3 + 5


def features(text: str | None) -> np.ndarray:
    """What the whole text looks like: how often byte classes follow one another, and how varied its words are.

    NULL counts as empty; the empty text has all features zero.
    """
    found = np.zeros(FEATURES)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return found
    kinds = _CLASS[np.frombuffer(b"\n" + data + b"\n", dtype=np.uint8)]
    shapes = np.bincount(kinds[:-2] * CLASSES**2 + kinds[1:-1] * CLASSES + kinds[2:], minlength=CLASSES**3)
    found[: CLASSES**3] = np.sqrt(shapes / len(data))
    words = data.split()
    if words:
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        lines = data.split(b"\n")
        found[CLASSES**3 :] = (
            len(set(words)) / len(words),
            repeats / len(words),
            min(len(data) / len(words), 100) / 10,
            np.log1p(len(words)) / 10,
            len(set(lines)) / len(lines),
        )
    return found


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    """A linear model of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability that a text is of the positives' kind, in order of the rows."""
        return _logistic((rows - self.mean) / self.scale @ self.weights + self.bias)


def _standardised(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The features by mean and scale, and a column of ones for the bias, with nothing in between kept."""
    made = np.ones((len(rows), len(mean) + 1))
    np.subtract(rows, mean, out=made[:, :-1])
    made[:, :-1] /= scale
    return made


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, rate: float, decay: float):
    """Weights and bias by gradient descent (Adam) on the logistic loss, of positives and unlabelled with a column of ones.

    With a prior, the risk is the non-negative unbiased one: what the positives cost, weighted by the
    prior, plus what the unlabelled cost as negatives less the share of it that the positives among them
    have. Where that difference falls below zero the model has begun to learn the sample by heart,
    and the step goes back up. Without a prior the unlabelled are simply the other class.
    """
    size = p.shape[1]
    weights, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        at_p, at_u = p @ weights, u @ weights
        as_positive = -p.T @ _logistic(-at_p) / len(p)  # gradients of the mean losses
        p_as_negative = p.T @ _logistic(at_p) / len(p)
        u_as_negative = u.T @ _logistic(at_u) / len(u)
        if prior is None:
            slope = 0.5 * as_positive + 0.5 * u_as_negative
        else:
            rest = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
            towards = u_as_negative - prior * p_as_negative
            slope = prior * as_positive + towards if rest >= 0 else -towards
        slope[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of the unlabelled that may be of the positives' kind.

    At any threshold of a score, the unlabelled above it hold at least their positives above it; so the
    share of the unlabelled above, over that of the positives above, is never below the prior and comes
    down to it where the others end. Each share gets its standard deviation as slack.
    """
    best = 1.0
    for threshold in np.quantile(positives, np.linspace(0, 0.9, 91)):
        ours, theirs = (positives >= threshold).mean(), (unlabelled >= threshold).mean()
        slack = np.sqrt(theirs * (1 - theirs) / len(unlabelled)) + np.sqrt(ours * (1 - ours) / len(positives))
        best = min(best, (theirs + slack) / ours)
    return float(np.clip(best, 0.01, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 300) -> Model:
    """Fit on the features of trusted positives and of unlabelled texts.

    Without a given prior, a first model tells the two samples apart on one half of each and the prior is
    read off its scores on the other half. Without positives every text gets 0.5.
    """
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    # A few columns at a time, and each sample let go as soon as it is standardised: the driver has little room.
    mean, scale = np.empty(FEATURES), np.empty(FEATURES)
    for at in range(0, FEATURES, 32):
        both = np.vstack([positives[:, at : at + 32], unlabelled[:, at : at + 32]])
        mean[at : at + 32], scale[at : at + 32] = both.mean(axis=0), both.std(axis=0) + 0.01
    p = _standardised(positives, mean, scale)
    del positives
    u = _standardised(unlabelled, mean, scale)
    del unlabelled
    if prior is None:
        if min(len(p), len(u)) < 20:
            prior = 0.5
        else:
            weights, _ = _descend(p[::2], u[::2], None, steps, 0.02, 1e-3)
            prior = estimate_prior(p[1::2, :-1] @ weights, u[1::2, :-1] @ weights)
    weights, bias = _descend(p, u, prior, steps, 0.02, 1e-4)
    return Model(mean, scale, weights, bias, prior)


def _measured(texts: DataFrame, text_col: str) -> np.ndarray:
    @F.pandas_udf("array<double>")
    def measure(column: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in column])

    # As Arrow columns, which take a fraction of the driver's memory that rows of numbers do.
    rows = texts.select(measure(F.col(text_col)).alias("features")).toArrow()["features"]
    return np.concatenate([np.empty(0), *(chunk.flatten().to_numpy() for chunk in rows.chunks)]).reshape(-1, FEATURES)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 4000,
    prior: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Learn what texts labelled 1 look like; both tables have only rows that may be learned from.

    The fit uses a bounded sample: at most ``sample`` documents labelled 1, and nothing but 1, and as many
    of all documents, unlabelled, both picked by a hash of the id. Only their features reach the driver.
    """
    trusted = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("least")).where("least = 1")
    picked = bounded_sample(trusted, id_col, sample, seed=1).select(id_col)
    # The ids are a bounded sample, hence the broadcast; ids that repeat in the documents stay bounded too.
    positives = docs.join(F.broadcast(picked), id_col, "left_semi").limit(2 * sample)
    unlabelled = bounded_sample(docs.select(id_col, text_col), id_col, sample, seed=2)
    return fit(_measured(positives, text_col), _measured(unlabelled, text_col), prior)


def quality_score(text: Column, model: Model) -> Column:
    """Score (0 to 1) of the whole text; NULL counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES)))

    return score(text)
