import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """``files`` table from {path: bytes or text}; a list of pairs keeps duplicates apart by bundle."""
    from sheafspark.schemas import FILES

    def make(contents, bundle="b"):
        rows = []
        for path, content in contents.items():
            data = content.encode() if isinstance(content, str) else content
            rows.append((bundle, path, len(data), bytearray(data), None))
        return spark.createDataFrame(rows, FILES)

    return make
