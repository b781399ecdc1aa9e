import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textdist.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(app="tests")


@pytest.fixture
def points(spark):
    """Rows (id, x) from a list of vectors."""

    def make(rows, start=0):
        data = [(start + i, [float(v) for v in (r if hasattr(r, "__len__") else [r])]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "id bigint, x array<double>")

    return make
