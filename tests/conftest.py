import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from quern.session import get_session

    session = get_session(
        "tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(schema, [...]) -> DataFrame."""
    return lambda schema, data: spark.createDataFrame(data, schema)
