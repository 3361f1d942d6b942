"""Models, folds, comparisons and explanations on MLlib."""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalar import decision, iso_date, usable
from txrisk.operators import boosting
from txrisk.operators.imputing import ExactImputer, ExactImputerModel
from txrisk.operators.ordering import average_rank, exact_quantiles
from txrisk.operators.ranking import Scored, evaluate_all, ranking_metrics
from txrisk.session import materialise
from txrisk.settings import (
    ABLATION_TOLERANCE,
    CV_FOLDS,
    ENTITY_FEATURE_MARKERS,
    EXPLANATIONS_PER_ROW,
    INFLUENCE_FLOOR,
    SCALE,
    Scale,
)


def prior_scores(train: DataFrame, frame: DataFrame, label: str) -> DataFrame:
    """The floor every model must beat: the training rate as a constant score."""
    rate = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    return frame.withColumn("score", rate)


def feature_columns(
    frame: DataFrame, excluded: Sequence[str], without_markers: Sequence[str] = ()
) -> list[str]:
    return [
        c
        for c in frame.columns
        if c not in excluded and not any(m in c for m in without_markers)
    ]


def entity_features(features: Sequence[str]) -> list[str]:
    return [c for c in features if any(m in c for m in ENTITY_FEATURE_MARKERS)]


@dataclass
class Candidate:
    """A named recipe: how to prepare rows, and the pipeline to fit on them."""

    name: str
    pipeline: Callable[[Sequence[str]], Pipeline]
    prepare: Callable[[DataFrame, Sequence[str]], DataFrame] = field(
        default=lambda frame, features: _as_double(frame, features)
    )
    # For recipes that stop on later rows, or keep to a number of rounds where there are none.
    recipe: boosting.Recipe | None = None
    rounds: int = 0
    patience: int = 0

    def with_rounds(self, rounds: int) -> Candidate:
        return replace(self, rounds=rounds, patience=0) if self.recipe else self


def _as_double(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    rest = [c for c in frame.columns if c not in set(features)]
    return frame.select(*rest, *[usable(c).alias(c) for c in features])


def _sentinel(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """MLlib trees know no missing value: give it one below all others."""
    rest = [c for c in frame.columns if c not in set(features)]
    return frame.select(
        *rest, *[F.coalesce(usable(c), F.lit(boosting.SENTINEL)).alias(c) for c in features]
    )


def logistic_candidate(label: str, max_iter: int = 50, reg: float = 1e-4) -> Candidate:
    """Median impute, standardise, logistic regression - all fitted on train."""

    def build(features: Sequence[str]) -> Pipeline:
        filled = [f"__f_{c}" for c in features]
        return Pipeline(
            stages=[
                ExactImputer(inputCols=list(features), outputCols=filled),
                VectorAssembler(inputCols=filled, outputCol="__raw"),
                StandardScaler(inputCol="__raw", outputCol="__z", withMean=True, withStd=True),
                LogisticRegression(
                    featuresCol="__z",
                    labelCol=label,
                    maxIter=max_iter,
                    regParam=reg,
                    standardization=False,
                    probabilityCol="__p",
                    rawPredictionCol="__m",
                    predictionCol="__c",
                ),
            ]
        )

    return Candidate("logistic", build)


def boosted_candidate(
    label: str, name: str = "boosted", rounds: int = 20, depth: int = 5, step: float = 0.1
) -> Candidate:
    def build(features: Sequence[str]) -> Pipeline:
        trees = GBTClassifier(
            featuresCol="__raw",
            labelCol=label,
            maxIter=rounds,
            maxDepth=depth,
            stepSize=step,
            seed=42,
        )
        trees.setProbabilityCol("__p").setRawPredictionCol("__m").setPredictionCol("__c")
        return Pipeline(
            stages=[VectorAssembler(inputCols=list(features), outputCol="__raw"), trees]
        )

    return Candidate(name, build, _sentinel)


def early_stopped_candidate(
    recipe: boosting.Recipe, max_rounds: int = 200, patience: int = 20
) -> Candidate:
    """Boosted trees of a recipe that stop when later rows say so."""
    return Candidate(recipe.name, lambda features: Pipeline(stages=[]), lambda frame, features: frame, recipe, max_rounds, patience)


def fit(
    candidate: Candidate,
    train: DataFrame,
    features: Sequence[str],
    label: str,
    valid: DataFrame | None = None,
) -> PipelineModel | boosting.BoostedModel:
    """Fit on `train`.  A candidate with patience stops by the rows of `valid`."""
    if candidate.recipe is not None:
        if candidate.patience and valid is not None:
            return boosting.early_stopped(
                candidate.recipe, train, valid, features, label, candidate.rounds, candidate.patience
            )
        return boosting.fixed_rounds(candidate.recipe, train, features, label, candidate.rounds)
    prepared = candidate.prepare(train.withColumn(label, F.col(label).cast("double")), features)
    return candidate.pipeline(features).fit(prepared)


def score(
    candidate: Candidate,
    model: PipelineModel,
    frame: DataFrame,
    features: Sequence[str],
    keep: Sequence[str],
    copies: dict[str, str] | None = None,
) -> DataFrame:
    """The kept columns and the probability of the positive class.

    ``copies`` names a second column for values to keep that may be features
    themselves, untouched by the model's preparation.
    """
    extra = [F.col(c).alias(new) for c, new in (copies or {}).items()]
    rows = frame.select(*keep, *features, *extra)
    out = model.transform(candidate.prepare(rows, features))
    return out.select(*keep, *(copies or {}).values(), vector_to_array("__p")[1].alias("score"))


def batch_scores(
    candidate: Candidate,
    model: PipelineModel,
    frame: DataFrame,
    features: Sequence[str],
    id_column: str,
    threshold: float,
) -> DataFrame:
    scored = score(candidate, model, frame, features, [id_column])
    return scored.withColumn("decision", decision("score", threshold))


def scaled_rounds(rounds: int, train_rows: int, all_rows: int) -> int:
    return max(1, round(rounds * all_rows / max(train_rows, 1)))


def refit_all(
    candidate: Callable[[int], Candidate],
    rounds: int,
    train_rows: int,
    all_rows: DataFrame,
    features: Sequence[str],
    label: str,
) -> tuple[Candidate, PipelineModel | boosting.BoostedModel]:
    """Fit on every labelled row, with rounds scaled by the growth in rows."""
    chosen = candidate(scaled_rounds(rounds, train_rows, all_rows.count()))
    return chosen, fit(chosen, all_rows, features, label)


PRIOR = "prior"


def compare_candidates(
    candidates: Sequence[Candidate],
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    names: Scored,
    scale: Scale = SCALE,
    prior: bool = False,
    fitted: dict[str, PipelineModel | boosting.BoostedModel] | None = None,
    **evaluation,
) -> DataFrame:
    """One row per candidate, the best average precision first: its metrics, the
    round it kept and the rounds it tried (null without rounds), and the seconds its fit took.

    `prior` adds the floor, the training rate as a constant score.  The models
    are left in `fitted`, if given.
    """
    keep = [names.id, names.label, names.amount]
    copies = {c: f"__k_{c}" for c in keep}
    table = []

    def judged(name: str, scored: DataFrame, best: int | None, tried: int | None, seconds: float) -> None:
        row = evaluate_all(materialise(scored, "candidate-scores"), names=names, scale=scale, **evaluation)
        table.append(
            row.select(
                F.lit(name).alias("model"), "*", F.lit(best).cast("int").alias("best_round"),
                F.lit(tried).cast("int").alias("rounds_tried"), F.lit(seconds).alias("fit_seconds"),
            )
        )

    if prior:
        began = clock.time()
        flat = prior_scores(train, valid.select(*keep), names.label)
        judged(PRIOR, flat.withColumnRenamed("score", names.score), None, None, clock.time() - began)
    for candidate in candidates:
        began = clock.time()
        model = fit(candidate, train, features, names.label, valid)
        seconds = clock.time() - began
        if fitted is not None:
            fitted[candidate.name] = model
        scored = score(candidate, model, valid, features, [], copies)
        scored = scored.select(*[F.col(k).alias(c) for c, k in copies.items()], F.col("score").alias(names.score))
        grown = isinstance(model, boosting.BoostedModel)
        judged(candidate.name, scored, *((model.best_round, model.rounds_tried) if grown else (None, None)), seconds)
    return reduce(DataFrame.unionByName, table).orderBy(F.desc("pr_auc"), "model")


# ----------------------------------------------------------------------- folds


def fold_edges(frame: DataFrame, time: str, folds: int = CV_FOLDS, scale: Scale = SCALE) -> list[float]:
    probs = [i / (folds + 1) for i in range(folds + 2)]
    return exact_quantiles(frame, [time], probs, scale=scale)[(None, time)]


def expanding_folds(
    frame: DataFrame, time: str, folds: int = CV_FOLDS, scale: Scale = SCALE
) -> DataFrame:
    """Each row once per fold it belongs to: ``train`` up to the fold's edge,
    ``valid`` between that edge and the next.

    A row names its folds from a few literal edges; no join is needed.
    """
    edges = fold_edges(frame, time, folds, scale)
    t = F.col(time)
    roles = [
        F.when(t <= F.lit(edges[i]), F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role")))
        .when(t <= F.lit(edges[i + 1]), F.struct(F.lit(i).alias("fold"), F.lit("valid").alias("role")))
        for i in range(1, folds + 1)
    ]
    return frame.select("*", F.inline(F.array_compact(F.array(*roles))))


def fold_summary(folded: DataFrame, time: str) -> DataFrame:
    valid = F.col("role") == "valid"
    return (
        folded.groupBy(F.col("fold").cast("long").alias("fold"))
        .agg(
            F.count_if(~valid).alias("train_rows"),
            F.count_if(valid).alias("valid_rows"),
            iso_date(F.min(F.when(valid, F.col(time)))).alias("valid_start"),
            iso_date(F.max(F.when(valid, F.col(time)))).alias("valid_end"),
        )
        .filter((F.col("train_rows") > 0) & (F.col("valid_rows") > 0))
    )


def cross_validate(
    candidate: Candidate,
    frame: DataFrame,
    features: Sequence[str],
    time: str,
    names: Scored,
    folds: int = CV_FOLDS,
    scale: Scale = SCALE,
) -> DataFrame:
    """Expanding-window folds with fixed rounds; metrics of all folds in one
    plan over the stacked scores.

    Every fold passes over the rows many times, so what the folds need of them is
    written first: joins behind the frame, and their broadcasts, run once."""
    frame = materialise(frame.select(*dict.fromkeys([time, names.label, *features])), "folds")
    edges = fold_edges(frame, time, folds, scale)
    t = F.col(time)
    scored = []
    for i in range(1, folds + 1):
        train = frame.filter(t <= F.lit(edges[i]))
        valid = frame.filter((t > F.lit(edges[i])) & (t <= F.lit(edges[i + 1])))
        if train.isEmpty() or valid.isEmpty():
            continue
        model = fit(candidate, train, features, names.label)
        part = score(candidate, model, valid, features, [names.label])
        scored.append(part.select(F.lit(i).cast("long").alias("fold"), names.label, F.col("score").alias(names.score)))
    stacked = reduce(DataFrame.unionByName, scored)
    metrics = ranking_metrics(stacked, names, ["fold"], scale).select(
        "fold", "pr_auc", "pr_auc_baseline", "pr_auc_lift", "roc_auc"
    )
    return fold_summary(expanding_folds(frame, time, folds, scale), time).join(metrics, "fold")


def fold_stability(cv: DataFrame) -> DataFrame:
    return cv.agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("pr_auc").alias("pr_auc_mean"),
        F.stddev_samp("pr_auc").alias("pr_auc_std"),
    )


def _same_medians(candidate: Candidate, model: PipelineModel | boosting.BoostedModel) -> Candidate:
    """The candidate with the medians that `model` learnt, for a fit on some of its features and the same rows."""
    learnt = [s for s in getattr(model, "stages", []) if isinstance(s, ExactImputerModel)]
    known = {c: m for s in learnt for c, m in s.surrogates().items()}

    def taken(stage):
        if not isinstance(stage, ExactImputer) or not set(stage.getInputCols()) <= set(known):
            return stage
        columns = stage.getInputCols()
        return ExactImputerModel(inputCols=columns, outputCols=stage.getOutputCols(), medians=[known[c] for c in columns])

    def build(features: Sequence[str]) -> Pipeline:
        return Pipeline(stages=[taken(s) for s in candidate.pipeline(features).getStages()])

    return replace(candidate, pipeline=build) if known else candidate


def ablation(
    candidate: Candidate,
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    removed: Sequence[str],
    names: Scored,
    tolerance: float = ABLATION_TOLERANCE,
    scale: Scale = SCALE,
) -> DataFrame:
    """Train with and without a feature family; drop it when that costs less
    average precision than a tolerance fixed beforehand.

    The second fit takes the medians of the first: its features are among those, its rows the same."""
    kept = [c for c in features if c not in set(removed)]
    scored = []
    for name, used in (("with", list(features)), ("without", kept)):
        model = fit(candidate, train, used, names.label, valid)
        part = score(candidate, model, valid, used, [names.label])
        candidate = _same_medians(candidate, model)
        scored.append(part.select(F.lit(name).alias("variant"), names.label, F.col("score").alias(names.score)))
    metrics = ranking_metrics(scored[0].unionByName(scored[1]), names, ["variant"], scale)
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("pr_auc")))
    return metrics.agg(pick("with").alias("with_pr_auc"), pick("without").alias("without_pr_auc")).select(
        "*",
        (F.col("with_pr_auc") - F.col("without_pr_auc")).alias("difference"),
        F.lit(tolerance).alias("tolerance"),
        (F.col("with_pr_auc") - F.col("without_pr_auc") < tolerance).alias("drop_family"),
    )


# ---------------------------------------------------------------- explanations


def linear_contributions(
    model: PipelineModel, frame: DataFrame, features: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Exact contribution of each feature to the linear score: weight times
    distance from the training mean, in units of its spread."""
    imputer, _, scaler, logistic = model.stages
    medians = imputer.surrogates()
    cells: list[Column] = []
    for i, c in enumerate(features):
        spread = float(scaler.std[i])
        weight = float(logistic.coefficients[i]) / spread if spread else 0.0
        x = F.coalesce(usable(c), F.lit(float(medians[c])))
        cells.append(((x - F.lit(float(scaler.mean[i]))) * F.lit(weight)).alias(c))
    return frame.select(*keep, *cells)


def logistic_gradient(
    candidate: Candidate, model: PipelineModel, train: DataFrame, features: Sequence[str], label: str
) -> dict[str, float]:
    """Slope of the penalised mean loss in each weight at the fitted weights: near zero at an optimum."""
    imputer, assembler, scaler, logistic = model.stages
    prepared = candidate.prepare(train.withColumn(label, F.col(label).cast("double")), features)
    ready = scaler.transform(assembler.transform(imputer.transform(prepared)))
    scored = logistic.transform(ready).select(
        (vector_to_array("__p")[1] - F.col(label)).alias("miss"), vector_to_array("__z").alias("z")
    )
    sums = scored.agg(*[F.avg(F.col("miss") * F.col("z")[i]).alias(f"g{i}") for i in range(len(features))]).first()
    penalty = logistic.getRegParam()
    return {c: sums[f"g{i}"] + penalty * float(logistic.coefficients[i]) for i, c in enumerate(features)}


def importance(
    model: PipelineModel | boosting.BoostedModel, frame: DataFrame, features: Sequence[str]
) -> DataFrame:
    """feature, weight: mean influence on a linear score, or the share of a boosted
    model's gain, in which an indicator counts for its feature."""
    if isinstance(model, boosting.BoostedModel):
        gains = dict.fromkeys(features, 0.0)
        names = [*model.features, *model.indicators]
        for name, gain in zip(names, model.trees.featureImportances.toArray(), strict=True):
            gains[name] += float(gain)
        rows = frame.sparkSession.createDataFrame(list(gains.items()), "feature string, weight double")
        return rows.orderBy(F.desc("weight"), "feature")
    parts = linear_contributions(model, frame, features, [])
    return importance_summary(parts, features).withColumnRenamed("mean_abs", "weight")


def importance_summary(
    contributions: DataFrame, features: Sequence[str], floor: float = INFLUENCE_FLOOR
) -> DataFrame:
    """Mean and greatest influence per feature, and on how many rows it spoke.

    One aggregate over the wide table; only the summary is made long.
    """
    aggs, cells = [], []
    for i, c in enumerate(features):
        size = F.abs(F.col(f"`{c}`"))
        aggs += [
            F.avg(size).alias(f"m{i}"),
            F.max(size).alias(f"x{i}"),
            F.count_if(size > floor).alias(f"r{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"m{i}").alias("mean_abs"),
                F.col(f"x{i}").alias("max_abs"),
                F.col(f"r{i}").alias("rows_with_influence"),
            )
        )
    long = contributions.agg(*aggs).select(F.inline(F.array(*cells)))
    return average_rank(long, "max_abs", "max_rank").orderBy(F.desc("mean_abs"), "feature")


def row_explanations(
    contributions: DataFrame, id_column: str, features: Sequence[str], n: int = EXPLANATIONS_PER_ROW
) -> DataFrame:
    """The n strongest contributions of every row, sorted inside the row: no
    shuffle and no window."""
    cells = F.array(
        *[
            F.struct(
                (-F.abs(F.col(f"`{c}`"))).alias("key"),
                F.lit(c).alias("feature"),
                F.col(f"`{c}`").alias("contribution"),
            )
            for c in features
        ]
    )
    top = F.slice(F.array_sort(cells), 1, n)
    return contributions.select(id_column, F.posexplode(top).alias("place", "e")).select(
        id_column,
        (F.col("place") + 1).cast("long").alias("place"),
        "e.feature",
        "e.contribution",
    )
