import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g")
    s.sparkContext.setLogLevel("OFF")
    yield s


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    return DATA
