import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shelfwright.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="shelfwright-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="shelfwright-test-")


def one(spark, expr, *cols, schema=None):
    """Evaluate a Column expression over a one-row DataFrame of ``cols``."""
    df = spark.createDataFrame([tuple(cols)], schema) if schema else spark.createDataFrame([tuple(cols)])
    return df.select(expr(df).alias("r")).collect()[0]["r"]
