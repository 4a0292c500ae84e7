import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ebbtide import schema as S  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("ebbtide-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


RAW_ROWS = [
    # Our own three customers: a newcomer on fiber, one in the second year whose total is blank, an old hand without internet.
    ("C001", "Male", 1, "No", "Yes", 4, "Yes", "Yes", "Fiber optic", "Yes", "No", "Yes", "No", "No", "Yes",
     "Month-to-month", "Yes", "Mailed check", 86.25, "351.0", "Yes"),
    ("C002", "Female", 0, "Yes", "Yes", 17, "No", "No phone service", "DSL", "No", "Yes", "No", "Yes", "Yes", "No",
     "One year", "No", "Electronic check", 41.6, " ", "No"),
    ("C003", "Male", 1, "No", "No", 51, "Yes", "No", "No", *["No internet service"] * 6,
     "Two year", "No", "Credit card (automatic)", 22.1, "1120.5", "No"),
]


@pytest.fixture(scope="session")
def raw(spark):
    return spark.createDataFrame(RAW_ROWS, S.RAW_SCHEMA)


# Unlabelled customers of very high, low and high risk.
EXAMPLES = [
    ("EX-001", "Male", 0, "No", "No", 5, "Yes", "Yes", "Fiber optic", "No", "Yes", "No", "No", "Yes", "No",
     "Month-to-month", "No", "Mailed check", 93.0, "452.0"),
    ("EX-002", "Male", 0, "Yes", "Yes", 47, "Yes", "No", "DSL", "Yes", "No", "Yes", "Yes", "No", "Yes",
     "Two year", "Yes", "Credit card (automatic)", 58.4, "2744.8"),
    ("EX-003", "Female", 1, "No", "No", 13, "Yes", "Yes", "DSL", "No", "No", "Yes", "No", "Yes", "No",
     "One year", "No", "Electronic check", 47.9, "622.7"),
]


@pytest.fixture(scope="session")
def examples(spark):
    from pyspark.sql import types as T

    return spark.createDataFrame(EXAMPLES, T.StructType(S.RAW_SCHEMA.fields[:-1]))


def rows(df, *columns):
    """The rows of a small result as tuples, sorted."""
    picked = df.select(*columns) if columns else df
    return sorted(tuple(row) for row in picked.collect())
