import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attestry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, app="tests", memory="4g", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return s


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one expression over literal columns."""
    def run(expr, **values):
        schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
        row = tuple(v for _, v in values.values()) or (1,)
        return spark.createDataFrame([row], schema).select(expr.alias("out")).first()["out"]

    return run
