"""One local session, and synthetic tables with known structure."""

from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from txrisk.session import build_session, clear_scratch, run_root
from txrisk.settings import Scale

# Forces the distributed way on small tables.
TINY = Scale(single_task_rows=50, broadcast_rows=5, hot_share=0.05, unpivot_columns=3, ks_ranges=7)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    left = os.path.exists(run_root(session))
    session.stop()
    assert not left


@pytest.fixture(scope="session")
def transactions(spark):
    """3,000 rows in time order; V1-V3 share their null rows and their source."""
    rng = np.random.default_rng(7)
    n = 3000
    one, two = rng.normal(size=n), rng.normal(size=n)
    gone = rng.random(n) < 0.2

    def near(base):
        return base + rng.normal(0, 0.05, n)

    pick = lambda *v: rng.choice(np.array(v, dtype=object), n)
    pdf = pd.DataFrame(
        {
            "TransactionID": np.arange(1_000_000, 1_000_000 + n),
            "TransactionDT": np.sort(rng.integers(86400, 120 * 86400, n)),
            "isFraud": (rng.random(n) < 0.05).astype(int),
            "TransactionAmt": np.round(rng.gamma(2, 60, n), 2),
            "card1": rng.integers(1000, 1100, n),
            "addr1": rng.integers(100, 120, n).astype(float),
            "D1": rng.integers(0, 60, n).astype(float),
            "D15": rng.integers(0, 100, n).astype(float),
            "ProductCD": pick("W", "C", "R", "H", "S"),
            "P_emaildomain": pick("gmail.com", "yahoo.com", "hotmail.co.uk", None),
            "R_emaildomain": pick("gmail.com", "aol.com", None),
            "DeviceInfo": pick("SAMSUNG SM-G892A Build/NRD90M", "Windows", "iOS Device"),
            "id_31": pick("chrome 62.0", "chrome 63.0", "safari generic"),
            "id_33": pick("1920x1080", "1334x750", None),
            "M1": pick("T", "F", None),
            "M4": pick("M0", "M1", "M2"),
            "V1": np.where(gone, np.nan, near(one)),
            "V2": np.where(gone, np.nan, near(one)),
            "V3": np.where(gone, np.nan, near(one)),
            "V4": near(two),
            "V5": near(two),
            "V6": near(two),
            "flat": 1.0,
        }
    )
    from txrisk.functions.scalar import nulls_for_nan

    frame = nulls_for_nan(spark.createDataFrame(pdf)).persist()
    frame.count()
    return frame


@pytest.fixture(scope="session")
def fitted(transactions):
    from pyspark.sql import functions as F

    from txrisk.operators.encoding import EncoderSpec, RiskEncoder

    spec = EncoderSpec(blocks=(("V1", "V2", "V3"), ("V4", "V5", "V6")))
    train = transactions.filter(F.col("TransactionID") < 1_002_400)
    return RiskEncoder(spec).fit(train)
