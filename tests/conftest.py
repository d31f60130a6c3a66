import pytest

from threadloom.session import session


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s = session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
