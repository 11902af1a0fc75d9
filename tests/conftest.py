import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomstat.session import local_session

    s = local_session(cores=4, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def market(spark):
    from loomstat.sources.binding import bind

    return bind(spark, SF_SMALL, "2001-08-02 00:00:00")
