import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", **{"spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a table from tuples and a schema string."""

    def build(data, schema):
        return spark.createDataFrame(data, schema)

    return build
