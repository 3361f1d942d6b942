"""Quality classifier: regularised quadratic discriminant analysis.

A document is described by a few statistics of its whole text, each moved to a
scale on which it is roughly normal.  Both classes get a mean and a covariance
shrunk towards a multiple of the identity.  The score is the logistic of the difference of the two log
densities, from Mahalanobis distances by Cholesky factors computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import fold, per_row, texts
from txrisk.session import materialise

FEATURES = (
    "log_words", "mean_word", "sd_word", "distinct_share", "top_share", "repeat_share",
    "upper_share", "digit_share", "symbol_share", "punctuation_share", "symbol_end_share",
    "line_words", "same_line_share", "entropy", "stop_share",
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_PUNCTUATION = b".,;:?'\"()-"
_PLAIN = _PUNCTUATION + bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b" \t\n\r\x0b\x0c"
_PLAIN += bytes(range(128, 256))
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"


def _logit(share: float, n: int) -> float:
    """Log odds of a share of n things, with half a thing added to both sides."""
    hits = share * n
    return math.log((hits + 0.5) / (n - hits + 0.5))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; an empty text has those of no words."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), len(raw)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / max(n, 1)
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    symbol_ends = sum(w[-1] in _SYMBOLS for w in words)
    short = sum(c for w, c in counts.items() if len(w) <= 3)

    def taken(kinds: bytes) -> float:
        return (size - len(raw.translate(None, kinds))) / max(size, 1)

    return [
        math.log1p(n),
        math.log1p(lengths.mean()) if n else 0.0,
        math.log1p(lengths.std()) if n else 0.0,
        _logit(len(counts) / max(n, 1), n),
        _logit(float(shares.max()) if n else 0.0, n),
        _logit(repeats / max(n, 1), n),
        _logit(taken(_UPPER), size),
        _logit(taken(_DIGIT), size),
        _logit(len(raw.translate(None, _PLAIN)) / max(size, 1), size),
        _logit(taken(_PUNCTUATION), size),
        _logit(symbol_ends / max(n, 1), n),
        math.log1p(n / max(len(lines), 1)),
        _logit(1 - len(set(lines)) / max(len(lines), 1), len(lines)),
        float(-(shares * np.log(shares)).sum()) / math.log(n + 2) if n else 0.0,
        _logit(short / max(n, 1), n),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, x (its statistics)."""
    return per_row(texts(docs), "text", lambda found: {"x": [statistics(t) for t in found]}, "x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Log prior odds, means, inverse Cholesky factors and half log determinants, class 0 first.

    `temper` divides the difference of log densities: statistics of one text
    depend on each other, so their densities claim more certainty than there is.
    """

    prior: float
    means: tuple[np.ndarray, ...]
    whiten: tuple[np.ndarray, ...]
    half_logdet: tuple[float, ...]
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 1 / (1 + math.exp(-self.prior)))
        logs = [
            -0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - d
            for m, w, d in zip(self.means, self.whiten, self.half_logdet, strict=True)
        ]
        odds = np.clip((logs[1] - logs[0]) / self.temper + self.prior, -700, 700)
        return 1 / (1 + np.exp(-odds))


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n, sums and products of each class in a batch of rows."""
    for frame in frames:
        for label, group in frame.groupby("label"):
            x = np.stack(group["x"].to_numpy())
            yield pd.DataFrame(
                {"label": [int(label)], "n": [len(x)], "s": [x.sum(axis=0)], "p": [(x.T @ x).ravel()]}
            )


def fit(described: DataFrame, labels: DataFrame, shrink: float = 0.05, temper: float = 2.0) -> Discriminant:
    """Fits on every labelled row: doc_id, label in 0/1 (other labels and null ids are ignored).

    Executors add up the moments; only sums of fixed size (classes x features^2)
    reach the driver.  Without a row of each class the score is the prior alone.
    """
    wanted = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    d = len(FEATURES)
    rows = described.join(wanted, "doc_id").select("label", "x")
    sums = rows.mapInPandas(_moments, "label int, n long, s array<double>, p array<double>")
    total = sums.groupBy("label").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.col("p")[i]) for i in range(d * d)]).alias("p"),
    )
    found = {r["label"]: r for r in total.collect()}
    counts = [found[c]["n"] if c in found else 0 for c in (0, 1)]
    prior = math.log((counts[1] + 1) / (counts[0] + 1))
    if not all(counts):
        return Discriminant(prior, (), (), (), temper)
    means, whiten, half = [], [], []
    for c in (0, 1):
        n, s, p = found[c]["n"], np.array(found[c]["s"]), np.array(found[c]["p"]).reshape(d, d)
        mean = s / n
        cov = p / n - np.outer(mean, mean)
        cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        half.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant(prior, tuple(means), tuple(whiten), tuple(half), temper)


def score(described: DataFrame, model: Discriminant, threshold: float) -> DataFrame:
    """doc_id, score, predicted."""

    def run(found: list) -> dict[str, list]:
        s = model.score(np.array(found))
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return per_row(described, "x", run, "score double, predicted int")


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5
) -> DataFrame:
    """Scores every document; learns only from labels outside fold 0.

    Returns doc_id, held_out, score, predicted, one row per row of `docs`.
    Null and empty texts are scored by their (empty) statistics, repeated rows
    each give a row, an empty table gives none.
    """
    described = materialise(describe(docs), "quality")
    learn = labels.select("doc_id", F.col("quality").alias("label")).filter(fold(folds) != 0)
    scored = score(described, fit(described, learn), threshold)
    return scored.select("doc_id", (fold(folds) == 0).alias("held_out"), "score", "predicted")
