import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from corpusflow.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=4, app_name="corpusflow-tests")
    yield s
    s.stop()


@pytest.fixture
def spread(spark):
    """Small tables over several partitions: AQE would put them into one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)
