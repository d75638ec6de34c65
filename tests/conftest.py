import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="lodestone-tests-"),
    }
    builder = SparkSession.builder.master("local[8]").appName("tests")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
