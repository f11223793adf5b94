from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from hiresift.session import local_session

    return local_session(8, "hiresift-tests")


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a one-argument column function over text values."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        rows = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
        return rows[0].r if len(values) == 1 else [r.r for r in rows]

    return run
