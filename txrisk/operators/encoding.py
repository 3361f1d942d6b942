"""Fitted feature encoding: learn on the earlier part of a table, apply the
same lookups to every later batch or stream.

All lookups of one label column - code, share, group means and spreads - live
in one row per label, so a column costs one join however many features it
feeds.  Nothing in ``transform`` looks at other rows of its input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from itertools import accumulate
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions import scalar as X
from txrisk.operators.joins import lookup_join, lookup_many, row_bytes
from txrisk.operators.ordering import exact_quantiles
from txrisk.operators.selection import block_reduce, judge_columns
from txrisk.session import materialise, scratch_path
from txrisk.settings import (
    BLOCK_CORRELATION,
    MISSING,
    NEAR_CONSTANT_SHARE,
    RESCUE_MIN_LIFT,
    RESCUE_MIN_ROWS,
    SCALE,
    TRAIN,
    TRAIN_QUANTILE,
    UNSEEN_CODE,
    VALID,
    Scale,
)


@dataclass(frozen=True)
class EncoderSpec:
    """Which column plays which role.  A role without a column is skipped.

    The defaults are fixed values: the columns of the public card-transaction
    dataset this encoding was designed on.
    """

    id: str = "TransactionID"
    time: str = "TransactionDT"
    label: str = "isFraud"
    amount: str = "TransactionAmt"
    passthrough: tuple[str, ...] = ()
    card: str = "card1"
    address: str = "addr1"
    age_days: str = "D1"
    emails: tuple[tuple[str, str], ...] = (("P", "P_emaildomain"), ("R", "R_emaildomain"))
    device: str = "DeviceInfo"
    browser: str = "id_31"
    screen: str = "id_33"
    match: tuple[str, ...] = tuple(f"M{i}" for i in range(1, 10))
    match_not_counted: tuple[str, ...] = ("M4",)
    frequency: tuple[str, ...] = (
        "card1", "card2", "card3", "card5", "addr1", "addr2",
        "P_emaildomain", "R_emaildomain", "DeviceInfo", "id_30", "id_31", "id_33",
        "card1_addr1", "uid", "P_email_provider", "R_email_provider",
        "device_brand", "browser_family",
    )
    aggregates: tuple[tuple[str, str], ...] = (
        ("card1", "TransactionAmt"),
        ("addr1", "TransactionAmt"),
        ("card1_addr1", "TransactionAmt"),
        ("uid", "TransactionAmt"),
        ("card1", "D15"),
        ("uid", "D15"),
    )
    blocks: tuple[tuple[str, ...], ...] = ()

    @property
    def pair(self) -> str:
        return f"{self.card}_{self.address}"

    @property
    def derived(self) -> list[str]:
        parts = [f"{p}_email_{kind}" for p, _ in self.emails for kind in ("provider", "suffix")]
        return [*parts, "device_brand", "browser_family", self.pair]

    @property
    def kept_aside(self) -> list[str]:
        return [self.id, self.time, self.label, *self.passthrough]


# ---------------------------------------------------------------- single maps


def frequency_map(frame: DataFrame, label: Column) -> DataFrame:
    """Share of rows per label, missing included."""
    rows = frame.count()
    return (
        frame.groupBy(label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n") / F.lit(rows))
    )


def category_map(frame: DataFrame, label: Column, scale: Scale = SCALE) -> DataFrame:
    """Labels numbered from 0 in sorted order, with their share of rows."""
    labels = frequency_map(frame, label).select(F.lit("c").alias("column"), "label", "share")
    return ordered_index(labels, "column", "label", "code", scale).select("label", "code", "share")


def group_aggregate_map(frame: DataFrame, label: Column, value: str) -> DataFrame:
    """Mean and sample spread per label, and its share of rows; the spread of
    a single row is null."""
    rows = frame.count()
    return frame.groupBy(label.alias("label")).agg(
        F.avg(F.col(value).cast("double")).alias("mean"),
        F.stddev_samp(F.col(value).cast("double")).alias("std"),
        (F.count(F.lit(1)) / F.lit(rows)).alias("share"),
    )


def ordered_index(
    frame: DataFrame, group: str, key: str, out: str, scale: Scale = SCALE
) -> DataFrame:
    """Number the distinct keys of each group from 0 in sorted order.

    Large groups are range-partitioned, written with their partition number,
    and numbered inside each partition from the count of the ones before.
    """
    sizes = frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    biggest = sizes.agg(F.max("n")).first()[0] or 0
    if biggest <= scale.single_task_rows:
        nth = F.row_number().over(W.partitionBy(group).orderBy(key))
        return frame.withColumn(out, (nth - 1).cast("long"))
    parts = max(2, -(-biggest // scale.single_task_rows))
    placed = materialise(
        frame.repartitionByRange(parts, group, key).withColumn("__part", F.spark_partition_id()),
        "ordered",
    )
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(group, "__part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(group, "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))
    )
    nth = F.row_number().over(W.partitionBy(group, "__part").orderBy(key))
    return (
        placed.withColumn("__nth", nth)
        .join(offsets, [group, "__part"])
        .withColumn(out, F.col("__off") + F.col("__nth") - 1)
        .drop("__part", "__nth", "__off")
    )


def encode_category(
    frame: DataFrame, label: str, codes: DataFrame, rows: int, out: str, scale: Scale = SCALE, size: int = 0
) -> DataFrame:
    """Code of each label, -1 for a label never seen."""
    joined = lookup_join(frame, label, codes, "label", rows, scale=scale, lookup_bytes=size)
    return joined.withColumn(out, F.coalesce("code", F.lit(UNSEEN_CODE))).drop("code", "share")


def encode_frequency(
    frame: DataFrame, label: str, shares: DataFrame, rows: int, out: str, scale: Scale = SCALE, size: int = 0
) -> DataFrame:
    """Share of each label, 0 for a label never seen."""
    served = shares.select("label", "share")
    joined = lookup_join(frame, label, served, "label", rows, scale=scale, lookup_bytes=size)
    return joined.withColumn(out, F.coalesce("share", F.lit(0.0))).drop("share")


# ------------------------------------------------------------------ estimator


class _EncoderParams(Params):
    """What the estimator is told and its model remembers, as ML params: ``copy``
    and ``fit`` with a param map change them, and they are saved with the stage."""

    roles: Param[dict] = Param(Params._dummy(), "roles", "the EncoderSpec, field by field")
    limits: Param[dict] = Param(Params._dummy(), "limits", "the Scale: where the distributed way begins")
    nearConstantShare: Param[float] = Param(
        Params._dummy(), "nearConstantShare", "share of one value that makes a column near-constant",
        TypeConverters.toFloat,
    )
    rescueMinRows: Param[int] = Param(
        Params._dummy(), "rescueMinRows", "rows beside that value that a rescue needs", TypeConverters.toInt
    )
    rescueMinLift: Param[float] = Param(
        Params._dummy(), "rescueMinLift", "lift of those rows, or its inverse, that rescues", TypeConverters.toFloat
    )
    blockCorrelation: Param[float] = Param(
        Params._dummy(), "blockCorrelation", "correlation that makes columns of a block redundant",
        TypeConverters.toFloat,
    )

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            roles=asdict(EncoderSpec()),
            limits=asdict(SCALE),
            nearConstantShare=NEAR_CONSTANT_SHARE,
            rescueMinRows=RESCUE_MIN_ROWS,
            rescueMinLift=RESCUE_MIN_LIFT,
            blockCorrelation=BLOCK_CORRELATION,
        )

    @property
    def spec(self) -> EncoderSpec:
        return EncoderSpec(**_tuples(self.getOrDefault(self.roles)))

    @property
    def scale(self) -> Scale:
        return Scale(**self.getOrDefault(self.limits))


class RiskEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Selects columns and learns the lookups, on training rows only."""

    def __init__(
        self,
        spec: EncoderSpec | None = None,
        near_constant_share: float = NEAR_CONSTANT_SHARE,
        rescue_min_rows: int = RESCUE_MIN_ROWS,
        rescue_min_lift: float = RESCUE_MIN_LIFT,
        block_correlation: float = BLOCK_CORRELATION,
        scale: Scale = SCALE,
    ):
        super().__init__()
        self._set(
            roles=asdict(spec or EncoderSpec()),
            limits=asdict(scale),
            nearConstantShare=near_constant_share,
            rescueMinRows=rescue_min_rows,
            rescueMinLift=rescue_min_lift,
            blockCorrelation=block_correlation,
        )

    def _fit(self, dataset: DataFrame) -> RiskEncoderModel:
        spec = self.spec
        if spec.label not in dataset.columns:
            raise ValueError(f"fit needs the label column {spec.label!r}: the rescue rule compares rates")
        candidates = [c for c in dataset.columns if c not in spec.kept_aside]
        # One row per column comes to the driver, here and below.
        judged = judge_columns(
            dataset,
            spec.label,
            candidates,
            threshold=self.getOrDefault(self.nearConstantShare),
            min_rare_rows=self.getOrDefault(self.rescueMinRows),
            min_lift=self.getOrDefault(self.rescueMinLift),
            scale=self.scale,
        ).collect()
        constant = {r["column"] for r in judged if r["is_constant"]}
        dropped = {r["column"] for r in judged if r["decision"] == "drop"} | constant
        survivors = [c for c in candidates if c not in dropped]
        # Fixed value: this reason is compared with reports made elsewhere.
        decisions = [
            (c, None, 1.0, 0, None, None, "drop", "single distinct value") for c in sorted(constant)
        ] + [tuple(r)[:8] for r in judged if r["column"] not in constant]

        blocks = [[c for c in b if c in survivors] for b in spec.blocks]
        in_blocks = {c for b in blocks for c in b}
        kept, evidence = [], None
        if in_blocks:
            kept, evidence = block_reduce(
                dataset, [b for b in blocks if b], self.getOrDefault(self.blockCorrelation), self.scale
            )
        base = [c for c in survivors if c not in in_blocks] + kept

        types = {f.name: f.dataType for f in dataset.schema.fields}
        categories = [c for c in base if isinstance(types[c], T.StringType)]
        roles = [spec.card, spec.address, spec.age_days, spec.browser, spec.device]
        wanted = set(categories) | {c for c in (*spec.frequency, *roles) if c in base}
        state = {
            "base": base,
            "base_types": {c: types[c].simpleString() for c in base},
            "categories": categories,
            "label_sources": sorted(wanted),
            "match": [c for c in spec.match if c in dataset.columns],
            "entity": all(c in base for c in (spec.card, spec.address, spec.age_days)),
            "lookup_rows": {},
            "lookup_bytes": {},
            "decisions": decisions,
        }
        lookups = self._learn(dataset, state, judged[0]["rows"])
        model = self._copyValues(RiskEncoderModel(state, lookups))
        model.block_evidence = evidence
        produced = model._features(dataset)
        state["features"] = [c for c in produced if c not in spec.kept_aside]
        return model

    def _learn(self, dataset: DataFrame, state: dict, rows: int) -> DataFrame:
        """All lookups from one shuffle: labels are stacked and aggregated
        where they arise, then coded, and written once."""
        spec = self.spec
        labels = label_columns(dataset, state, self.spec)
        coded = [c for c in [*state["categories"], *spec.derived] if c in labels]
        counted = [c for c in spec.frequency if c in labels]
        specs = [(g, v) for g, v in spec.aggregates if g in labels and v in dataset.columns]
        state["coded"], state["counted"], state["aggregates"] = coded, counted, specs
        names = list(dict.fromkeys([*coded, *counted, *[g for g, _ in specs]]))
        values = list(dict.fromkeys(v for _, v in specs))
        work = dataset.select(
            *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)],
            *[labels[c].alias(c) for c in names],
        )
        stacked = work.unpivot([f"__v{i}" for i in range(len(values))], names, "column", "label")
        learnt = stacked.groupBy("column", "label").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(f"__v{i}").alias(f"mean_{i}") for i in range(len(values))],
            *[F.stddev_samp(f"__v{i}").alias(f"std_{i}") for i in range(len(values))],
        ).withColumn("share", F.col("n") / F.lit(float(rows)))
        learnt = materialise(learnt, "labels")
        codes = ordered_index(
            learnt.filter(F.col("column").isin(coded)).select("column", "label"),
            "column",
            "label",
            "code",
            self.scale,
        )
        spark = dataset.sparkSession
        path = scratch_path(spark, "lookups")
        write_lookups(learnt.join(codes, ["column", "label"], "left"), path)
        state["values"] = values
        table = spark.read.parquet(path)
        sizes = table.groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.sum(row_bytes("label", table.columns)).alias("bytes")
        ).orderBy("bytes", "column").collect()
        state["lookup_rows"] = {r["column"]: r["n"] for r in sizes}
        # Broadcasts of one plan are held together, so the bound is on their sum,
        # from the smallest table on.
        sums = accumulate(r["bytes"] for r in sizes)
        state["lookup_bytes"] = {r["column"]: total for r, total in zip(sizes, sums)}
        return table


def write_lookups(lookups: DataFrame, path: str) -> None:
    """One folder per column.  Ranges of (column, label) give few files: a range
    holds few columns, and a column with very many labels is cut into several."""
    lookups.repartitionByRange("column", "label").write.partitionBy("column").parquet(path)


def label_columns(frame: DataFrame, state: dict, spec: EncoderSpec) -> dict[str, Column]:
    """Text form of every column that is counted, coded or grouped by."""
    labels: dict[str, Column] = {}
    for c in state["label_sources"]:
        labels[c] = X.label_of(frame, c) if c in frame.columns else F.lit(MISSING)
    for prefix, column in spec.emails:
        provider, suffix = (
            X.domain_parts(labels[column]) if column in labels else (F.lit(MISSING), F.lit(MISSING))
        )
        labels[f"{prefix}_email_provider"], labels[f"{prefix}_email_suffix"] = provider, suffix
    for name, column in (("device_brand", spec.device), ("browser_family", spec.browser)):
        labels[name] = X.first_token(labels[column]) if column in labels else F.lit(MISSING)
    both = spec.card in labels and spec.address in labels
    labels[spec.pair] = (
        X.join_labels(labels[spec.card], labels[spec.address]) if both else F.lit(MISSING)
    )
    ready = state["entity"] and all(
        c in frame.columns for c in (spec.card, spec.address, spec.time, spec.age_days)
    )
    labels["uid"] = (
        X.entity_key(frame, spec.card, spec.address, spec.time, spec.age_days)
        if ready
        else F.lit(MISSING)
    )
    return labels


def _tuples(spec: dict) -> dict:
    deep = lambda v: tuple(deep(x) for x in v) if isinstance(v, (list, tuple)) else v
    return {k: deep(v) for k, v in spec.items()}


class RiskEncoderModel(Model, _EncoderParams, MLWritable, MLReadable):
    """Column choice, lookups and the frozen feature order.

    Saves and loads as any ML stage does, alone or in a ``PipelineModel``.  The
    lookups of a loaded model stay in its folder and are read when rows are
    encoded, so a pipeline must not be saved over the folder it was loaded from.
    """

    def __init__(self, state: dict[str, Any], lookups: DataFrame):
        super().__init__()
        self.state = state
        self.lookups = lookups
        self.block_evidence: DataFrame | None = None

    def write(self) -> MLWriter:
        return _EncoderModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderModelReader()

    @property
    def feature_names(self) -> list[str]:
        return self.state["features"]

    def column_decisions(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [tuple(d) for d in self.state["decisions"]],
            "column string, dominant_value string, dominant_share double, rare_rows long, "
            "rare_rate double, lift double, decision string, reason string",
        )

    def manifest(self) -> list[tuple[str, str, str]]:
        """(feature, kind, source) in the frozen order."""
        kinds = self._kinds()
        return [(f, *kinds[f]) for f in self.feature_names]

    def _kinds(self) -> dict[str, tuple[str, str]]:
        # The kind names are compared with manifests made elsewhere.
        spec, state = self.spec, self.state
        out = {c: ("base_numeric", c) for c in state["base"] if c not in state["categories"]}
        out |= {c: ("derived_time", spec.time) for c in ("hour", "day_of_week")}
        out |= {
            c: ("derived_amount", spec.amount)
            for c in ("amount_log", "amount_cents", "amount_is_round")
        }
        out |= {c: ("derived_match", "match") for c in ("match_true_count", "match_missing_count")}
        out |= {
            c: ("derived_screen", spec.screen)
            for c in ("screen_width", "screen_height", "screen_area")
        }
        out["email_domains_match"] = ("derived_email", "/".join(c for _, c in spec.emails))
        out |= {f"{c}_code": ("category_code", c) for c in state["coded"]}
        out |= {f"{c}_freq": ("frequency", c) for c in state["counted"]}
        for g, v in state["aggregates"]:
            for name in aggregate_names(g, v):
                out[name] = ("aggregate", f"{v} by {g}")
        return out

    def _features(self, frame: DataFrame) -> dict[str, Column]:
        """Feature expressions over a frame to which the lookups were joined."""
        spec, state = self.spec, self.state
        labels = label_columns(frame, state, spec)
        out: dict[str, Column] = {}
        clash: list[str] = []

        def add(name: str, value: Column) -> None:
            if name in out:
                clash.append(name)
            out[name] = value

        for c in state["base"]:
            if c in state["categories"]:
                continue
            present = F.col(c) if c in frame.columns else F.lit(None)
            add(c, present.cast(state["base_types"][c]))
        add("hour", X.hour_of(spec.time))
        add("day_of_week", X.day_of_week(spec.time))
        cents = X.amount_cents(spec.amount)
        add("amount_log", F.log1p(F.col(spec.amount).cast("double")))
        add("amount_cents", cents)
        add("amount_is_round", (cents == 0).cast("int"))
        if state["match"]:
            hits, blanks = X.match_counts(frame, state["match"], spec.match_not_counted)
            absent = len([c for c in state["match"] if c not in frame.columns])
            add("match_true_count", hits)
            add("match_missing_count", blanks + F.lit(absent))
        if spec.screen in labels:
            for name, value in zip(
                ("screen_width", "screen_height", "screen_area"),
                X.dimension_parts(labels[spec.screen]),
            ):
                add(name, value)
        if len(spec.emails) == 2 and all(c in labels for _, c in spec.emails):
            (_, left), (_, right) = spec.emails
            add("email_domains_match", X.domains_match(labels[left], labels[right]))
        at = {c: i for i, c in enumerate(self._looked_up())}
        for c in state["coded"]:
            add(f"{c}_code", F.coalesce(F.col(f"__code_{at[c]}"), F.lit(UNSEEN_CODE)))
        for c in state["counted"]:
            add(f"{c}_freq", F.coalesce(F.col(f"__share_{at[c]}"), F.lit(0.0)))
        for g, v in state["aggregates"]:
            i, j = at[g], state["values"].index(v)
            mean, std = F.col(f"__mean_{j}_{i}"), F.col(f"__std_{j}_{i}")
            value = F.col(v).cast("double") if v in frame.columns else F.lit(None).cast("double")
            for name, expr in zip(
                aggregate_names(g, v), (mean, std, X.ratio_or_null(value, mean))
            ):
                add(name, expr)
        if clash:
            raise ValueError(f"duplicate feature names: {clash}")
        return out

    def _looked_up(self) -> list[str]:
        s = self.state
        return list(dict.fromkeys([*s["coded"], *s["counted"], *[g for g, _ in s["aggregates"]]]))

    def _values_of(self, label: str) -> list[str]:
        """What features take from the lookup of a label column."""
        used = [self.state["values"].index(v) for g, v in self.state["aggregates"] if g == label]
        code = ["code"] if label in self.state["coded"] else []
        return ["share", *code, *[f"{kind}_{j}" for j in used for kind in ("mean", "std")]]

    def _is_large(self, label: str) -> bool:
        rows, size = (self.state[k].get(label, 0) for k in ("lookup_rows", "lookup_bytes"))
        return rows > self.scale.broadcast_rows or size > self.scale.broadcast_bytes

    def _sources(self) -> set[str]:
        """Columns that features are made of, and those kept beside them."""
        spec, state = self.spec, self.state
        roles = [spec.amount, spec.card, spec.address, spec.age_days, spec.device, spec.browser, spec.screen]
        named = [*spec.kept_aside, *roles, *[c for _, c in spec.emails]]
        return {*named, *state["base"], *state["label_sources"], *state["match"], *state["values"]}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.state
        carried = [c for c in self.spec.kept_aside if c in dataset.columns]
        labels = label_columns(dataset, state, self.spec)
        names = self._looked_up()
        needed = [c for c in dataset.columns if c in self._sources()]
        work = dataset.select(*needed, *[labels[c].alias(f"__l_{i}") for i, c in enumerate(names)])
        large = [] if dataset.isStreaming else [c for c in names if self._is_large(c)]
        together = large if len(large) > 1 else []
        for i, c in enumerate(names):
            if c in together:
                continue
            table = self.lookups.filter(F.col("column") == c).select(
                F.col("label"), *[F.col(v).alias(f"__{v}_{i}") for v in self._values_of(c)]
            )
            work = lookup_join(
                work,
                f"__l_{i}",
                table,
                "label",
                state["lookup_rows"].get(c, 0),
                share=f"__share_{i}",
                scale=self.scale,
                lookup_bytes=state["lookup_bytes"].get(c, 0),
            )
        if together:
            at = {c: i for i, c in enumerate(names)}
            work = lookup_many(
                work,
                {c: f"__l_{at[c]}" for c in together},
                self.lookups,
                {c: self._values_of(c) for c in together},
                self.scale,
            )
            found = {f"{v}@{c}": f"__{v}_{at[c]}" for c in together for v in self._values_of(c)}
            work = work.withColumnsRenamed(found)
        exprs = self._features(work)
        return work.select(*carried, *[exprs[f].alias(f) for f in self.feature_names])


class _EncoderModelWriter(MLWriter):
    """Params and the rest of the state as metadata, the lookups as Parquet."""

    def __init__(self, model: RiskEncoderModel):
        super().__init__()
        self.model = model

    def save(self, path: str) -> None:
        if self.shouldOverwrite and _lies_under(self.model.lookups, path):
            raise ValueError(f"the model reads its lookups from {path}; save it elsewhere")
        super().save(path)

    def saveImpl(self, path: str) -> None:
        evidence = self.model.block_evidence
        extra = {"state": self.model.state, "evidence": evidence is not None}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        write_lookups(self.model.lookups, f"{path}/lookups")
        if evidence is not None:
            evidence.write.parquet(f"{path}/evidence")


class _EncoderModelReader(MLReader):
    def load(self, path: str) -> RiskEncoderModel:
        spark = self.sparkSession
        expected = f"{RiskEncoderModel.__module__}.{RiskEncoderModel.__name__}"
        metadata = DefaultParamsReader.loadMetadata(path, spark, expected)
        state = metadata["state"]
        state["aggregates"] = [tuple(a) for a in state["aggregates"]]
        model = RiskEncoderModel(state, spark.read.parquet(f"{path}/lookups"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        if metadata["evidence"]:
            model.block_evidence = spark.read.parquet(f"{path}/evidence")
        return model


def _lies_under(frame: DataFrame, path: str) -> bool:
    plain = lambda p: p.split(":", 1)[-1].rstrip("/").replace("///", "/")
    return any(plain(f).startswith(f"{plain(path)}/") for f in frame.inputFiles())


def aggregate_names(group: str, value: str) -> tuple[str, str, str]:
    return (
        f"{value}_mean_by_{group}",
        f"{value}_std_by_{group}",
        f"{value}_ratio_to_{group}_mean",
    )


# --------------------------------------------------------------- split, checks


def time_split(
    frame: DataFrame, time: str, quantile: float = TRAIN_QUANTILE, scale: Scale = SCALE
) -> tuple[DataFrame, float]:
    """Label rows ``train`` up to the time quantile and ``valid`` after it."""
    boundary = exact_quantiles(frame, [time], [quantile], scale=scale)[(None, time)][0]
    return frame.withColumn(
        "split", F.when(F.col(time) <= F.lit(boundary), TRAIN).otherwise(VALID)
    ), boundary


def split_summary(frame: DataFrame, time: str, label: str, split: str = "split") -> DataFrame:
    return frame.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("long")).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
        X.iso_date(F.min(time)).alias("start"),
        X.iso_date(F.max(time)).alias("end"),
    )


def null_shares(frame: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    aggs = [
        F.bround(F.avg(F.when(F.col(f"`{c}`").isNull(), 1.0).otherwise(0.0)) * 100, 2).alias(c)
        for c in columns
    ]
    return frame.agg(*aggs).unpivot([], list(columns), "feature", out)


def feature_manifest(model: RiskEncoderModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """What each feature is, where it comes from, and how often it is null."""
    spark = train.sparkSession
    listed = spark.createDataFrame(model.manifest(), "feature string, kind string, source string")
    names = model.feature_names
    return listed.join(null_shares(train, names, "missing_pct_train"), "feature").join(
        null_shares(test, names, "missing_pct_test"), "feature"
    )


def unseen_share(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of frequency cells that are zero."""
    zero = sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in columns), F.lit(0))
    return frame.agg(
        F.coalesce(
            F.try_divide(F.sum(zero).cast("double"), F.count(F.lit(1)) * len(columns)), F.lit(0.0)
        ).alias("unseen_share")
    )


def feature_checks(train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Four silent failures, one row each, with the columns at fault."""
    spark = train.sparkSession
    in_train, in_test = list(features), [c for c in test.columns if c in set(features)]
    fixed = spark.createDataFrame(
        [
            ("label_in_features", [label] if label in in_train else []),
            ("columns_differ", sorted(set(in_train) ^ set(in_test)) if in_train != in_test else []),
        ],
        "check string, columns array<string>",
    )
    number = {
        f.name for f in train.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    row = train.agg(
        *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(in_train)],
        *[
            F.count_if(F.abs(F.col(f"`{c}`")) == float("inf")).alias(f"i{i}")
            for i, c in enumerate(in_train)
            if c in number
        ],
    )
    blank = F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(c)) for i, c in enumerate(in_train)])
    infinite = F.array(
        *[F.when(F.col(f"i{i}") > 0, F.lit(c)) for i, c in enumerate(in_train) if c in number]
    ).cast("array<string>")
    found = row.select(
        F.inline(
            F.array(
                F.struct(F.lit("all_null").alias("check"), F.array_compact(blank).alias("columns")),
                F.struct(F.lit("infinite").alias("check"), F.array_compact(infinite).alias("columns")),
            )
        )
    )
    return fixed.unionByName(found).select(
        "check", (F.size("columns") == 0).alias("passed"), F.array_join("columns", ", ").alias("columns")
    )


def clock_leak_check(
    frame: DataFrame,
    features: Sequence[str],
    time: str,
    limit: float = 0.98,
    min_rows: int = 100,
) -> DataFrame:
    """Features that track the clock: |correlation with time| above the limit."""
    t = F.col(time).cast("double")
    aggs, cells = [], []
    for i, c in enumerate(features):
        x = X.usable(c)
        then = F.when(x.isNotNull(), t)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.covar_pop(x, then).alias(f"c{i}"),
            (F.stddev_pop(x) * F.stddev_pop(then)).alias(f"s{i}"),
        ]
        r = F.try_divide(F.col(f"c{i}"), F.col(f"s{i}"))
        cells.append(
            F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("rows"), r.alias("correlation"))
        )
    return (
        frame.agg(*aggs)
        .select(F.inline(F.array(*cells)))
        .withColumn(
            "tracks_clock",
            F.coalesce(
                (F.col("rows") >= min_rows) & (F.abs("correlation") > limit), F.lit(False)
            ),
        )
    )
