import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ticklake.session import get_spark
    s = get_spark(cpus="*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def bars_h(spark):
    from ticklake.sources.bars import bars_h as mk
    return mk(spark, SF).cache()
