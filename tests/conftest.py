import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files_of(spark):
    def make(**contents):
        rows = [("repo", p.replace("__", "/"), c) for p, c in contents.items()]
        return spark.createDataFrame(rows, "root string, path string, content string")

    return make


@pytest.fixture
def corpus(spark):
    def make(contents: dict, root: str = "repo"):
        rows = [(root, p, c) for p, c in contents.items()]
        return spark.createDataFrame(rows, "root string, path string, content string")

    return make
