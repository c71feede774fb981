import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plantpulse.schemas import READINGS  # noqa: E402
from plantpulse.session import build_session, work_path  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.sql.streaming.schemaInference": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    return work_path(spark, "test")


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Build:
    """Shorthand for reading rows."""

    def __init__(self, spark):
        self.spark = spark

    def __call__(self, *rows, **common):
        out = []
        for i, row in enumerate(rows):
            r = {"data_id": f"d{i:03d}", "event_time": datetime(2024, 1, 1), "robot_id": "R001", "sensor_id": "S001",
                 "sensor_type": "TEMPERATURE", "status": "NORMAL", **common, **row}
            out.append(tuple(r.get(f.name) for f in READINGS.fields))
        return self.spark.createDataFrame(out, READINGS)


@pytest.fixture
def readings(spark):
    return Build(spark)
