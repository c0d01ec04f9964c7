import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from boxtally.session import local_session  # noqa: E402

BOX = ("x1", "y1", "x2", "y2", "z1", "z2")


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Small tables of detections and ground truth from tuples."""

    def dets(rows, extra=""):
        ddl = "case_id string, det_id long, label long, score double, x1 double, y1 double, x2 double, y2 double, z1 double, z2 double"
        return spark.createDataFrame(rows, ddl + extra)

    def gts(rows):
        ddl = "case_id string, gt_id long, label long, grade long, supervised boolean, ignore boolean, x1 double, y1 double, x2 double, y2 double, z1 double, z2 double"
        return spark.createDataFrame(rows, ddl)

    return type("Make", (), {"dets": staticmethod(dets), "gts": staticmethod(gts)})
