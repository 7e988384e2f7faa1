import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from matchloom.session import build_session

    s = build_session("tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column on a single row."""
    def run(col, **values):
        df = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
        return df.select(col.alias("v")).first()["v"]

    return run
