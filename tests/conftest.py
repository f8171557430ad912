import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog.check import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# Columns cannot be built without a session, and test modules build some on import.
SESSION = local_session(4)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture
def values(spark):
    """Run an expression over a column ``x`` of strings and list the results in order."""

    def run(texts, expression):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i int, x string")
        return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]

    return run


@pytest.fixture
def make_posts(spark):
    def build(*contents, dates=None):
        rows = [
            (i + 1, (dates[i] if dates else "2024-01-01"), c) for i, c in enumerate(contents)
        ]
        return spark.createDataFrame(rows, "id long, date string, content string")

    return build


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
