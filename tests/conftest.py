import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cutline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        "cutline-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def tiny_chunks(spark):
    """Force every scan to split keys, so carries are exercised on small data."""
    spark.conf.set("spark.cutline.rowsPerChunk", "5")
    yield
    spark.conf.unset("spark.cutline.rowsPerChunk")
