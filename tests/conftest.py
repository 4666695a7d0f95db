import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    builder = SparkSession.builder.master("local[4]").appName("diffloom-tests").config("spark.sql.shuffle.partitions", "4")
    builder = builder.config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.sql.session.timeZone", "UTC")
    spark = builder.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(str(base / "checkpoints"))
    yield spark
    spark.stop()
