import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    root = str(Path(__file__).resolve().parents[1])
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.ui.retainedExecutions", "20")
        .config("spark.executorEnv.PYTHONPATH", root)
        .getOrCreate()
    )
    s.sparkContext.environment["PYTHONPATH"] = root
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
