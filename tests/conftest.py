import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from strandline.session import local_session

    return local_session("tests")


@pytest.fixture
def line(spark):
    """Lines from {line_id: [(lat, lon), ...]}."""

    def make(lines):
        rows = [(k, i + 1, float(a), float(o)) for k, pts in lines.items() for i, (a, o) in enumerate(pts)]
        return spark.createDataFrame(rows, "line_id BIGINT, seq INT, lat DOUBLE, lon DOUBLE")

    return make
