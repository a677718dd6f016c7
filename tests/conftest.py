import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallygrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    from tallygrid.sources.rules import rows as make

    return lambda schema, values: make(spark, schema, values)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
