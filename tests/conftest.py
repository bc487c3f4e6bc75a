import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from threadtide.session import get_session

    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from tests.compare import connect

    return connect(SF_DIR)


@pytest.fixture
def values(spark):
    """One value per row of an expression over a single string column x."""
    from pyspark.sql import functions as F

    def run(rows, column, schema="x string"):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
        return [r["v"] for r in df.select("i", column(F.col(schema.split()[0])).alias("v")).orderBy("i").collect()]

    return run
