from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from remap.session import prepare  # noqa: E402


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("remap-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return prepare(spark)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return make_session()
