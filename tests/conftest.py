import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from toolcorpus.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4)
    yield s


def one(spark, value, col="t"):
    """Evaluate a Column function on a one-row DataFrame."""
    return spark.createDataFrame([(value,)], f"{col} string")
