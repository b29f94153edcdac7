import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradelanes.dimensions import CountryBook
from tradelanes.plans.shared_tables import SharedTables
from tradelanes.session import build_session

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tradelanes-tests-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shared(spark):
    return SharedTables(spark, TABLES)


@pytest.fixture(scope="session")
def book():
    return CountryBook.standard()


@pytest.fixture
def values(spark):
    """Evaluate expressions over named doubles, one row."""

    def run(build, **numbers):
        columns = ", ".join(f"{name} double" for name in numbers)
        df = spark.createDataFrame([tuple(numbers.values())], columns)
        return df.select(build().alias("result")).first()["result"]

    return run
