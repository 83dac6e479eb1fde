import pytest

from sluiceway.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
