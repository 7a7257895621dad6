import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from slicewise.session import build_session
    s = build_session("local[4]", app="slicewise-tests", shuffle_partitions=8, driver_memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


def unique_by(df, key):
    """Rows whose ``key`` occurs once (the small table has one repeated line-item key)."""
    from pyspark.sql import functions as F
    once = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c = 1").select(key)
    return df.join(once, key)
