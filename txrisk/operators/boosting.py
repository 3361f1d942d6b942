"""Boosted trees that stop when average precision on later rows stops rising.

MLlib grows the trees.  Its trees are the same for a longer run with the same
seed and rows, so a model that may still improve is grown again with twice the
rounds: the work is at most twice that of the last run.  After each run one
pass over the validation rows gives the score after every round: a row's leaf
in each tree, the leaf's value, and their running sum.

Missing values get a sentinel below all others, and each feature with missing
training values an indicator column beside it, so that a tree can part missing
rows from the lowest ones.  Rows are assembled once and written; every run
reads that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalar import usable
from txrisk.operators.ranking import Scored, ranking_metrics
from txrisk.session import materialise
from txrisk.settings import SCALE, Scale

SENTINEL = -999_999.0
_ROWS = "__x"


@dataclass(frozen=True)
class Recipe:
    """How trees are grown; `columns` and `rows` are the shares each tree draws."""

    name: str
    depth: int
    step: float = 0.05
    min_rows: int = 1
    columns: float = 1.0
    rows: float = 1.0
    seed: int = 42


# The step, depths, leaf sizes and shares of the three families that are compared.
RECIPES = (
    Recipe("leafy", depth=6, min_rows=100, columns=0.8, rows=0.8),
    Recipe("deep", depth=8, min_rows=5, columns=0.8, rows=0.8),
    Recipe("plain", depth=6),
)


def indicated(train: DataFrame, features: Sequence[str]) -> list[str]:
    """The features with missing training values, found in one pass."""
    if not features:
        return []
    gaps = train.agg(*[F.count_if(usable(c).isNull()).alias(f"g{i}") for i, c in enumerate(features)]).first()
    return [c for i, c in enumerate(features) if gaps[f"g{i}"]]


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-2 * margin))


@dataclass(frozen=True)
class BoostedModel:
    """The first `best_round` trees of a run; `log` has a row for each round tried."""

    trees: GBTClassificationModel
    features: tuple[str, ...]
    indicators: tuple[str, ...]
    best_round: int
    log: tuple[dict, ...] = field(default=())
    runs: int = 1

    @property
    def rounds_tried(self) -> int:
        return len(self.log) or self.best_round

    def leaf_values(self) -> list[list[float]]:
        return leaf_values(self.trees)[: self.best_round]

    def transform(self, frame: DataFrame) -> DataFrame:
        """Adds `__p`, the probabilities of both classes, to rows with the features."""
        leaves = self.trees.setLeafCol("__leaf").transform(assembled(frame, self.features, self.indicators))
        values = F.array(*[F.array(*[F.lit(v) for v in tree]) for tree in self.leaf_values()])
        parts = F.zip_with(
            values, F.slice(vector_to_array("__leaf"), 1, self.best_round), lambda tree, leaf: tree[leaf.cast("int")]
        )
        score = probability(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))
        return (
            leaves.withColumn("__s", score)
            .withColumn("__p", array_to_vector(F.array(1 - F.col("__s"), F.col("__s"))))
            .drop(_ROWS, "__leaf", "__s", *_trained_columns(self.trees))
        )


def _trained_columns(trees: GBTClassificationModel) -> list[str]:
    return [trees.getRawPredictionCol(), trees.getProbabilityCol(), trees.getPredictionCol()]


def assembled(frame: DataFrame, features: Sequence[str], indicators: Sequence[str]) -> DataFrame:
    """The rows with one vector of features and indicators beside them."""
    cells = [F.coalesce(usable(c), F.lit(SENTINEL)).alias(f"__v{i}") for i, c in enumerate(features)]
    cells += [usable(c).isNull().cast("double").alias(f"__g{i}") for i, c in enumerate(indicators)]
    names = [f"__v{i}" for i in range(len(features))] + [f"__g{i}" for i in range(len(indicators))]
    wide = frame.select("*", *cells)
    return VectorAssembler(inputCols=names, outputCol=_ROWS).transform(wide).drop(*names)


def leaf_values(trees: GBTClassificationModel) -> list[list[float]]:
    """What each leaf of each tree adds to the margin, in the order of leaf numbers (left to right)."""
    parts = re.split(r"Tree \d+ \(weight [^)]*\):", trees.toDebugString)[1:]
    return [
        [weight * float(v) for v in re.findall(r"Predict: (\S+)", part)]
        for weight, part in zip(trees.treeWeights, parts, strict=True)
    ]


def grow(rows: DataFrame, label: str, recipe: Recipe, rounds: int) -> GBTClassificationModel:
    trees = GBTClassifier(
        featuresCol=_ROWS, labelCol=label, maxIter=rounds, maxDepth=recipe.depth, stepSize=recipe.step,
        minInstancesPerNode=recipe.min_rows, subsamplingRate=recipe.rows,
        featureSubsetStrategy="all" if recipe.columns >= 1 else str(recipe.columns), seed=recipe.seed,
    )
    trees.setProbabilityCol("__tp").setRawPredictionCol("__tm").setPredictionCol("__tc")
    return trees.fit(rows)


def round_scores(trees: GBTClassificationModel, rows: DataFrame, label: str) -> DataFrame:
    """round, label, score of every row after every round."""
    values = leaf_values(trees)
    most = max(map(len, values))
    table = np.array([v + [0.0] * (most - len(v)) for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, 500_000 // len(table))):
                piece = batch.slice(start, max(1, 500_000 // len(table)))
                leaves = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(table))
                margins = np.cumsum(table[np.arange(len(table)), leaves], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(1, len(table) + 1), len(leaves)), pa.int32()),
                        pa.array(np.repeat(piece.column(0).to_numpy(zero_copy_only=False), len(table)), pa.float64()),
                        pa.array(margins.reshape(-1), pa.float64()),
                    ],
                    names=["round", "label", "margin"],
                )

    leaves = trees.setLeafCol("__leaf").transform(rows).select(F.col(label).alias("label"), vector_to_array("__leaf").alias("leaves"))
    found = leaves.mapInArrow(run, "round int, label double, margin double")
    return found.select("round", F.col("label").cast("long").alias("label"), probability(F.col("margin")).alias("score"))


def stopping_point(precisions: Sequence[float], patience: int) -> tuple[int, int, bool]:
    """Best round, rounds tried, and whether patience ran out: after the first
    run of `patience` rounds without a rise nothing more is tried."""
    best = 1
    for at, ap in enumerate(precisions, 1):
        if ap > precisions[best - 1]:
            best = at
        if at - best >= patience:
            return best, at, True
    return best, len(precisions), False


def early_stopped(
    recipe: Recipe,
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    label: str,
    max_rounds: int = 200,
    patience: int = 20,
    first_rounds: int = 20,
    scale: Scale = SCALE,
) -> BoostedModel:
    """Grow trees on `train` until average precision on `valid` has not risen for `patience` rounds."""
    indicators = indicated(train, features)
    ready = lambda frame, name: materialise(
        assembled(frame, features, indicators).select(F.col(label).cast("double").alias("label"), _ROWS), name
    )
    rows, later = ready(train, "boost-train"), ready(valid, "boost-valid")
    names = Scored(score="score", label="label")
    rounds, runs = min(first_rounds, max_rounds), 0
    while True:
        trees = grow(rows, "label", recipe, rounds)
        runs += 1
        scored = materialise(round_scores(trees, later, "label"), "round-scores")
        found = ranking_metrics(scored, names, ["round"], scale).select("round", "pr_auc", "roc_auc").collect()
        log = sorted((r.asDict() for r in found), key=lambda r: r["round"])
        best, tried, stopped = stopping_point([r["pr_auc"] if r["pr_auc"] is not None else -1.0 for r in log], patience)
        if stopped or rounds >= max_rounds:
            return BoostedModel(trees, tuple(features), tuple(indicators), best, tuple(log[:tried]), runs)
        rounds = min(2 * rounds, max_rounds)


def fixed_rounds(recipe: Recipe, train: DataFrame, features: Sequence[str], label: str, rounds: int) -> BoostedModel:
    """Trees without validation rows: for folds and for the last fit on all rows."""
    indicators = indicated(train, features)
    rows = materialise(
        assembled(train, features, indicators).select(F.col(label).cast("double").alias("label"), _ROWS), "boost-train"
    )
    return BoostedModel(grow(rows, "label", recipe, rounds), tuple(features), tuple(indicators), rounds)


def log_frame(train: DataFrame, model: BoostedModel) -> DataFrame:
    """The rounds tried as a table: round, pr_auc, roc_auc, kept."""
    rows = [(r["round"], r["pr_auc"], r["roc_auc"], r["round"] <= model.best_round) for r in model.log]
    return train.sparkSession.createDataFrame(rows, "round int, pr_auc double, roc_auc double, kept boolean")
