import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskframe.session import local_session  # noqa: E402
from riskframe.sources import fixtures  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def txn(spark):
    return fixtures.txn(spark, SF).persist()


@pytest.fixture(scope="session")
def scored(txn):
    return fixtures.scored(txn).select("txn_id", "Class", "Amount", "score").persist()


@pytest.fixture(scope="session")
def bounds(spark):
    amounts = [0.0, 9.99, 10.0, 99.99, 100.0, 499.99, 500.0, 999.99, 1000.0, None]
    rows = [(i, a, i % 2) for i, a in enumerate(amounts)]
    return spark.createDataFrame(rows, "id int, Amount double, Class int")
