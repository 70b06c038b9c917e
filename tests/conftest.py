import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bazaar.schema import COLUMNS, RAW_SCHEMA, SALES_SCHEMA  # noqa: E402
from bazaar.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("local[2]", shuffle_partitions=4)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture
def sales(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), SALES_SCHEMA)
    return make


@pytest.fixture
def raw(spark):
    def make(*dicts):
        rows = [tuple(d.get(c, None) for c in COLUMNS) for d in dicts]
        return spark.createDataFrame(rows, RAW_SCHEMA)
    return make
