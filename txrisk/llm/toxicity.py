"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms (words, and the stems they begin
with).  Spark counts each bucket over all labelled rows; the buckets
that tell the classes apart carry a weight and a factor vector each.  Pairs of
present terms add the product of their factors, so an insult next to a group
mention can count for more than the two apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import fold, give_back, per_row, texts
from txrisk.session import materialise

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str, bits: int, stems: tuple[int, ...]) -> np.ndarray:
    """Sorted distinct buckets of the words of a whole text and of their stems."""
    mask = (1 << bits) - 1
    words = {w.encode() for w in _WORD.findall(text.lower())}
    found = {crc32(w) & mask for w in words}
    for n in stems:
        found |= {crc32(s, n) & mask for s in {w[:n] for w in words if len(w) > n}}
    return np.fromiter(sorted(found), dtype=np.int32, count=len(found))


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows that the weights are fitted on; bucket
    counts always cover all labelled rows.  A bucket whose own z is under `least_z`
    is held by a penalty of `penalty` standard deviations of what chance adds to its gradient."""

    bits: int = 20
    stems: tuple[int, ...] = (5,)
    sample: int = 40_000
    factors: int = 6
    epochs: int = 40
    batch: int = 512
    fold: int = 10
    patience: int = 4
    rate: float = 0.1
    factor_rate: float = 0.05
    decay: float = 2e-4
    least_z: float = 4.5
    penalty: float = 1.5
    seed: int = 7


@dataclass(frozen=True)
class Machine:
    """bias + sum of weights + half of (square of summed factors - summed squares)."""

    index: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def slots(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.index, buckets)
        at[at == len(self.index)] = 0
        return at[self.index[at] == buckets] if len(self.index) else at[:0]

    def score(self, slots: np.ndarray) -> float:
        v = self.factor[slots]
        pair = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        odds = self.bias + float(self.weight[slots].sum()) + pair
        return float(1 / (1 + np.exp(-np.clip(odds, -700, 700))))


def _bucket_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for label, group in frame.groupby("label"):
            found, n = np.unique(np.concatenate(group["terms"].to_list()), return_counts=True)
            yield pd.DataFrame({"label": int(label), "bucket": found, "n": n})


def counted_buckets(labelled: DataFrame, totals: dict[int, int], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of the labelled rows, sorted, and which of them do not tell the classes apart alone.

    At most 2^bits pairs of numbers reach the driver."""
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
    counted = labelled.select("label", "terms").mapInPandas(give_back(_bucket_counts), "label int, bucket int, n long")
    sides = counted.groupBy("bucket").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"),
    )
    share = (F.col("p") + F.col("q")) / F.lit(float(pos + neg))
    z = (F.col("p") / pos - F.col("q") / neg) / F.sqrt(
        F.greatest(share * (1 - share), F.lit(1.0 / (pos + neg))) * (1.0 / pos + 1.0 / neg)
    )
    found = sides.select("bucket", (F.abs(z) < settings.least_z).alias("held")).toArrow()
    index, held = found["bucket"].to_numpy(), found["held"].to_numpy()
    order = np.argsort(index)
    return index[order], held[order]


class _Rows:
    """Some rows as flat places in the index, and the buckets that they use."""

    def __init__(self, starts: np.ndarray, flat: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        lengths = np.diff(starts)[rows]
        self.labels = labels[rows].astype(np.float32)
        self.filled = np.flatnonzero(lengths)
        self.begins = (np.cumsum(lengths) - lengths)[self.filled]
        self.lengths = lengths.astype(np.int32)
        own = np.concatenate([flat[starts[i] : starts[i + 1]] for i in rows])
        self.used, at = np.unique(own, return_inverse=True)
        self.at = at.astype(np.int32)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The value of its row for each term."""
        return np.repeat(values, self.lengths)

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """Sums over the terms of each row; a row without terms has zero."""
        found = np.zeros((len(self.labels), *values.shape[1:]), dtype=values.dtype)
        if len(self.begins):
            found[self.filled] = np.add.reduceat(values, self.begins, axis=0)
        return found

    def odds(self, b: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each row and its summed factors; `w` and `v` are those of `used`."""
        vectors = np.take(v, self.at, axis=0)
        sums = self.by_row(vectors)
        squares = self.by_row(np.einsum("ij,ij->i", vectors, vectors))
        pairs = 0.5 * (np.einsum("ij,ij->i", sums, sums) - squares)
        return b + self.by_row(np.take(w, self.at)) + pairs, sums

    def loss(self, b: float, w: np.ndarray, v: np.ndarray) -> float:
        odds, _ = self.odds(b, w[self.used], v[self.used])
        odds = np.clip(odds, -30, 30)
        return float(np.mean(np.log1p(np.exp(odds)) - self.labels * odds))


def _arranged(
    starts: np.ndarray, flat: np.ndarray, labels: np.ndarray, m: int, settings: Settings
) -> tuple[list[_Rows], _Rows | None, np.ndarray]:
    """Batches of rows, the rows kept aside, and the rows of each of `m` buckets.

    Row i has the places in the index from flat[starts[i]] to before flat[starts[i + 1]]."""
    n = len(labels)
    order = np.random.default_rng(settings.seed).permutation(n)
    aside, rest = order[: n // settings.fold], order[n // settings.fold :]
    batches = [_Rows(starts, flat, labels, some) for some in np.array_split(rest, max(1, len(rest) // settings.batch))]
    judge = _Rows(starts, flat, labels, aside) if len(aside) else None
    return batches, judge, np.bincount(flat, minlength=m)


def _descend(
    batches: list[_Rows], judge: _Rows | None, n_rows: np.ndarray, labels: np.ndarray,
    index: np.ndarray, held: np.ndarray, settings: Settings,
) -> Machine:
    """Minibatch AdaGrad on the logistic loss of the factorization machine.

    Every `fold`-th row is kept aside: when its loss has not fallen for `patience`
    epochs the best weights so far are taken.  Batches are arranged once and taken in
    a new order each epoch; steps touch the buckets of a batch only.  Held buckets
    are drawn to zero, the factors of one as a group; the draw grows with the root of
    their rows, as chance does."""
    rng = np.random.default_rng(settings.seed)
    m, k, n = len(index), settings.factors, len(labels)
    w, v, b = np.zeros(m, dtype=np.float32), rng.normal(0, 0.05, (m, k)).astype(np.float32), 0.0
    gw, gv, gb = np.full(m, 1e-8, dtype=np.float32), np.full((m, k), 1e-8, dtype=np.float32), 1e-8
    v[n_rows == 0] = 0
    n_batches = len(batches)
    spread = labels.mean() * (1 - labels.mean())
    draw = settings.penalty * held * np.sqrt(spread * n_rows) / n * n_batches / np.clip(n_rows, 1, n_batches)
    draw = draw.astype(np.float32)
    best, since, kept = np.inf, 0, (b, w, v)
    for _ in range(settings.epochs):
        for i in rng.permutation(n_batches):
            rows = batches[i]
            used, at, size = rows.used, rows.at, len(rows.labels)
            if not len(used):
                continue
            wu, vu = w[used], v[used]
            odds, sums = rows.odds(b, wu, vu)
            error = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - rows.labels) / size).astype(np.float32)
            total = np.bincount(at, rows.spread(error), len(used)).astype(np.float32)
            dw = total + settings.decay * wu
            dv = (settings.decay - total[:, None]) * vu
            met = error[:, None] * sums
            for f in range(k):
                dv[:, f] += np.bincount(at, rows.spread(met[:, f]), len(used))
            db = float(error.sum())
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db**2
            pace = settings.rate / np.sqrt(gw[used])
            wu = wu - pace * dw
            w[used] = np.sign(wu) * np.maximum(0, np.abs(wu) - pace * draw[used])
            vu = vu - settings.factor_rate * dv / np.sqrt(gv[used])
            pace = settings.factor_rate / np.sqrt(gv[used].mean(axis=1)) * np.sqrt((sums**2).sum(axis=1).mean())
            far = np.sqrt((vu**2).sum(axis=1)) + 1e-12
            v[used] = vu * np.maximum(0, 1 - pace * draw[used] / far)[:, None]
            b -= settings.rate * db / np.sqrt(gb)
        if judge is None:
            kept = (b, w, v)
            continue
        loss = judge.loss(b, w, v)
        if loss < best - 1e-5:
            best, since, kept = loss, 0, (b, w.copy(), v.copy())
        else:
            since += 1
            if since >= settings.patience:
                break
    b, w, v = kept
    moved = (w != 0) | v.any(axis=1)  # the others add nothing to any score
    return Machine(index[moved], b, w[moved], v[moved])


def least_rows(labelled: DataFrame, n: int, rows: int) -> DataFrame:
    """The `n` of `rows` labelled rows with the least hash of doc_id, in that order.

    No task holds more than about `n` of them with their terms: the others are left out by a
    bound on the hash before any row is sorted."""
    place = F.xxhash64("doc_id")
    share, near = n / max(rows, 1), labelled
    while share < 1:
        share += 6 * (share / rows) ** 0.5
        near = labelled.filter(place <= min(int((share - 0.5) * 2**64), 2**63 - 1))
        if near.count() >= n:
            break
        share, near = 2 * share, labelled
    return near.orderBy(place, "doc_id", "label").limit(n)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    """Learns from documents with a label (doc_id, label in 0/1); other labels are ignored.

    One task fits the weights on the rows of the sample; only the buckets and the weights reach the driver."""
    wanted = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")

    def listed(found: list) -> dict[str, list]:
        return {"terms": pa.array([terms(t, settings.bits, settings.stems) for t in found], pa.list_(pa.int32()))}

    # Merged at any size: labels grow as the documents do, so a broadcast of them has no bound.
    joined = texts(docs).join(wanted.hint("merge"), "doc_id").select(F.struct("doc_id", "label").alias("of"), "text")
    labelled = materialise(
        per_row(joined, "text", listed, "terms array<int>", carry="of").select("of.doc_id", "of.label", "terms"), "toxicity"
    )
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    index, held = counted_buckets(labelled, totals, settings)
    chosen = least_rows(labelled, settings.sample, sum(totals.values()))
    if not len(index):
        seen = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
        share = (seen["pos"] + 1) / (seen["n"] + 2)
        return Machine(index, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, settings.factors)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows])
        y = table["label"].to_numpy().astype(np.float64)
        arranged = _batches(table["terms"], y, index, settings)
        del table
        model = _descend(*arranged, y, index, held, settings)
        yield _sent(-1, [model.bias], np.zeros((1, settings.factors), dtype=np.float32))
        for at in range(0, len(model.index), 50_000):
            part = slice(at, at + 50_000)
            yield _sent(model.index[part], model.weight[part], model.factor[part])

    fitted = chosen.select("label", "terms").mapInArrow(give_back(run), "bucket int, weight double, factor array<float>").toArrow()
    bucket, weight = fitted["bucket"].to_numpy(), fitted["weight"].to_numpy()
    factor = fitted["factor"].combine_chunks().flatten().to_numpy().reshape(len(bucket), settings.factors)
    own = bucket >= 0  # the other row is the bias
    return Machine(bucket[own], float(weight[~own][0]), weight[own].astype(np.float32), factor[own])


def _sent(buckets, weights, factors: np.ndarray) -> pa.RecordBatch:
    k = factors.shape[1]
    starts = pa.array(np.arange(0, factors.size + 1, k, dtype=np.int32))
    lists = pa.ListArray.from_arrays(starts, pa.array(factors.ravel(), pa.float32()))
    columns = [pa.array(np.atleast_1d(buckets), pa.int32()), pa.array(weights, pa.float64()), lists]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "weight", "factor"])


def _batches(terms: pa.ChunkedArray, labels: np.ndarray, index: np.ndarray, settings: Settings):
    found = [c for c in terms.chunks if len(c)]
    lengths = np.concatenate([c.value_lengths().to_numpy() for c in found])
    flat = np.empty(int(lengths.sum()), dtype=np.int32)
    at = 0
    for chunk in found:
        values = chunk.flatten().to_numpy()
        flat[at : at + len(values)] = np.searchsorted(index, values)
        at += len(values)
    return _arranged(np.concatenate([[0], np.cumsum(lengths)]), flat, labels, len(index), settings)


def score(docs: DataFrame, model: Machine, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score for every whole text; an empty text has no terms and scores the bias."""

    def run(found: list) -> dict[str, list]:
        return {"score": [model.score(model.slots(terms(t, settings.bits, settings.stems))) for t in found]}

    return per_row(texts(docs), "text", run, "score double")


def training_rows(labels: DataFrame, folds: int = 5) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").alias("label")).filter(fold(folds) != 0)


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, settings: Settings = Settings()
) -> DataFrame:
    """Scores every document; learns only from labels outside fold 0.

    Returns doc_id, held_out, score, predicted, one row per row of `docs`;
    repeated rows each give a row, an empty table gives none.
    """
    model = fit(docs, training_rows(labels, folds), settings)
    return score(docs, model, settings).select(
        "doc_id",
        (fold(folds) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, settings: Settings = Settings()
) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns."""
    model = fit(docs, training_rows(labels, folds), settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                model.score(model.slots(terms(t.as_py() or "", settings.bits, settings.stems))) < threshold
                for t in batch.column("text")
            ]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(give_back(run), docs.schema)
