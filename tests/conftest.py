import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from markwell.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def one(spark):
    """Evaluate a column built from ``F.col('t')`` for one value."""
    def run(build, value, kind="string"):
        return spark.createDataFrame([(value,)], f"t {kind}").select(build("t").alias("x")).first()["x"]

    return run
