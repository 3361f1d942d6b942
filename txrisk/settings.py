"""Tunable values, grouped by the stage that reads them.

The defaults are fixed values: results are only comparable with earlier
reports when they stay as written.  Every operator takes them as arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, field

MISSING = "(missing)"
UNSEEN_CODE = -1
SECONDS_PER_HOUR = 3600
SECONDS_PER_DAY = 86400
TRAIN, VALID = "train", "valid"
TRAIN_QUANTILE = 0.8

# Rate tables
MIN_CATEGORY_ROWS = 500

# Column selection
NEAR_CONSTANT_SHARE = 0.99
RESCUE_MIN_ROWS = 500
RESCUE_MIN_LIFT = 2.0
BLOCK_CORRELATION = 0.75

# Type narrowing
FLOAT32_WHOLE_LIMIT = 2**24
CATEGORY_DISTINCT_RATIO = 0.5

# Review rates printed in every report, and the staffed share of rows
HEADLINE_REVIEW_RATES = (0.005, 0.01, 0.02, 0.05)
REVIEW_CAPACITY = 0.02

# Models
CV_FOLDS = 4
ABLATION_TOLERANCE = 0.005
ENTITY_FEATURE_MARKERS = ("_by_uid", "_to_uid_", "uid_freq")
EXPLANATIONS_PER_ROW = 6
INFLUENCE_FLOOR = 0.01

# Distinct-count sketches have 2^14 registers; merged ones err by 1.04 / 2^7.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


@dataclass(frozen=True)
class CostModel:
    """Prices of the four outcomes of a review decision."""

    review: float = 4.0
    chargeback: float = 25.0
    friction: float = 1.0
    recovery: float = 0.90


@dataclass(frozen=True)
class DriftRules:
    """Buckets, floors and thresholds of the drift report."""

    bins: int = 10
    epsilon: float = 1e-6
    stable: float = 0.10
    significant: float = 0.25
    min_rows: int = 1000
    low_confidence_rows: int = 5000
    top_features: int = 20
    retrain_weighted: float = 0.15
    retrain_top_significant: int = 3
    watch_weighted: float = 0.05
    alert_tolerance: float = 0.50


@dataclass(frozen=True)
class PeriodRules:
    """Which periods are long enough to measure and to call complete."""

    min_rows: int = 500
    min_positives: int = 10
    full_rows: int = 15_000


@dataclass(frozen=True)
class Scale:
    """Size limits that switch between the small and the distributed way.

    Both ways give the same result; the limits only bound how much data one
    task or one broadcast may hold.
    """

    single_task_rows: int = 200_000
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 * 2**20
    hot_share: float = 0.001
    unpivot_columns: int = 50
    ks_ranges: int = 200
    value_buckets: int = 4096


COST = CostModel()
DRIFT = DriftRules()
PERIOD = PeriodRules()
SCALE = Scale()
