import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from contentflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, memory="6g", scratch=tempfile.mkdtemp(prefix="contentflow-tests-"))
    yield session


@pytest.fixture
def values(spark):
    """Evaluate a Column function over a list of inputs."""

    def run(function, inputs, kind="string"):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        from pyspark.sql import functions as F

        rows = frame.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()
        return [r["out"] for r in rows]

    return run
