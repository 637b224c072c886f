import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tidemark-tests", memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def value(spark):
    """Value of one column expression over an optional row."""

    def evaluate(column, **row):
        frame = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
        return frame.select(column.alias("v")).first()[0]

    return evaluate
