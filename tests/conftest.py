import pytest

from sievework.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("4", "tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
