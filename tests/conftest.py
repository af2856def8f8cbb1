import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(_HERE.parent))
# Python workers import the package and the models of the tests.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(_HERE.parent), str(_HERE), *filter(None, [os.environ.get("PYTHONPATH")])]
)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("vivabank-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of a column function over a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        out = rows.select("i", fn(F.col("x")).alias("y")).collect()
        return [r.y for r in sorted(out, key=lambda r: r.i)]

    return run
