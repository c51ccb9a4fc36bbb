import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield session
    session.stop()


def windows_of(spark, data, repo="r"):
    """{metric: [values of window 0, values of window 1, ...]} as a windowed table."""
    rows = []
    for metric, windows in data.items():
        for w, values in enumerate(windows):
            rows += [(repo, metric, f"{metric}{w}-{i:05d}", f"s{i}", w, float(v), i) for i, v in enumerate(values)]
    schema = "repo_id string, metric_id string, observation_id string, source_id string, window_index int, value double, k int"
    return spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_seconds(1700000000 + window_index * 86400 + k) as ts").drop("k")


@pytest.fixture
def make_windows(spark):
    return lambda data, repo="r": windows_of(spark, data, repo)
